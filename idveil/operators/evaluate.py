"""Quality: feedback checks, recall and precision on labelled samples, synthetic values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idveil.functions import recognizers as r
from idveil.functions.checksums import gstin_check_digit, verhoeff_check_digit
from idveil.functions.columns import as_col, strip

_FINDERS = {
    "AADHAAR": r.find_aadhaar,
    "PAN": r.find_pan,
    "GSTIN": r.find_gstin,
    "IN_MOBILE": r.find_mobile,
    "VOTER_ID": r.find_voter_id,
    "PASSPORT": r.find_passport,
    "BANK_ACCOUNT": r.find_bank_account,
    "IFSC": r.find_ifsc,
}
FEEDBACK_ENTITIES = ("AADHAAR", "PAN", "GSTIN", "IN_MOBILE")


def _hits(entity: Column, text: Column, names, high_only: Column) -> Column:
    """Number of matches of the row's own entity; null for an entity not in *names*."""

    def count(name: str) -> Column:
        found = _FINDERS[name](text)
        high = F.size(F.filter(found, lambda m: m["confidence"] == "HIGH"))
        return F.when(high_only, high).otherwise(F.size(found))

    return F.coalesce(*[F.when(entity == n, count(n)) for n in names])


def check_feedback(feedback: DataFrame) -> DataFrame:
    """Each reported sample with ``matches`` and ``passed``.

    FP: nothing may be found at HIGH (mobiles: nothing at all). FN: something must be
    found. Other entities have no check: an FP passes, an FN fails. Blank samples are
    left out.
    """
    kind = F.upper(strip("feedback_type"))
    entity = F.upper(strip("entity_type"))
    sample = strip("raw_sample_value")
    staged = feedback.withColumns(
        {"feedback_type": kind, "entity_type": entity, "raw_sample_value": sample}
    ).where((sample != "") & kind.isin("FP", "FN"))
    kind, entity, sample = (
        F.col(c) for c in ("feedback_type", "entity_type", "raw_sample_value")
    )
    high_only = (kind == "FP") & (entity != "IN_MOBILE")
    matches = F.coalesce(_hits(entity, sample, FEEDBACK_ENTITIES, high_only), F.lit(0))
    counted = staged.withColumn("matches", matches)
    passed = F.when(kind == "FP", F.col("matches") == 0).otherwise(F.col("matches") >= 1)
    return counted.withColumn("passed", passed)


def score_corpus(corpus: DataFrame) -> DataFrame:
    """Recall and false-positive rate per entity of ``corpus(entity, kind, value)``.

    ``kind`` is positive, variant or negative. A positive counts as found at any
    confidence; a negative counts as a false positive at HIGH (mobiles, voter cards
    and passports, which never reach HIGH on their own: at any confidence).
    """
    never_high = ("IN_MOBILE", "VOTER_ID", "PASSPORT", "BANK_ACCOUNT", "IFSC")
    negative = F.col("kind") == "negative"
    high_only = negative & ~F.col("entity").isin(*never_high)
    hit = _hits(F.col("entity"), F.col("value"), _FINDERS, high_only) > 0
    counted = corpus.select("entity", negative.alias("negative"), hit.alias("hit"))
    grouped = counted.groupBy("entity").agg(
        F.count_if(~F.col("negative")).alias("positives"),
        F.count_if(~F.col("negative") & F.col("hit")).alias("found"),
        F.count_if(F.col("negative")).alias("negatives"),
        F.count_if(F.col("negative") & F.col("hit")).alias("false_positives"),
    )
    found, false = F.col("found"), F.col("false_positives")
    return grouped.select(
        "*",
        (found / F.nullif("positives", F.lit(0))).alias("recall"),
        (false / F.nullif("negatives", F.lit(0))).alias("false_positive_rate"),
        (found / F.nullif(found + false, F.lit(0))).alias("precision"),
    )


def make_aadhaar(prefix11: Column | str) -> Column:
    """A valid number from an eleven-digit prefix."""
    prefix = as_col(prefix11)
    return F.concat(prefix, verhoeff_check_digit(prefix))


def make_gstin(prefix14: Column | str) -> Column:
    """A valid number from a fourteen-character prefix."""
    prefix = as_col(prefix14)
    return F.concat(prefix, gstin_check_digit(prefix))
