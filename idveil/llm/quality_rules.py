"""Quality rules: a learned decision list of threshold conjunctions, emitted as one ordered conditional expression.

Statistics of a text are built-in expressions. Learning reads labelled statistics only: a bounded sample of
labelled rows is binned by Spark at quantile thresholds and counted per distinct combination of bins; sequential
covering then grows a conjunction by FOIL gain on one half of the counts, prunes it on the other half, and removes
what it covers. A conjunction that is not precise enough bars its first statistic from beginning another one until a
rule is found; learning ends when no beginning is left.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idveil.llm.common import SPACES, WORD, let, table, written

#: Labelled rows that learning uses at most.
MAX_TRAINING_ROWS = 20_000
#: Thresholds are the middles between neighbouring ones of these quantiles of a statistic.
QUANTILES = tuple(i / 32 for i in range(33))
#: A rule must be this precise on the growing and on the pruning half, and cover so many bad rows in the growing half.
MIN_PRECISION, MIN_COVER = 0.95, 5
MAX_RULES, MAX_CONDITIONS = 16, 4

#: What the rules may test. Shares are of the characters or words of the text, 0 for a text without words.
STATISTICS = (
    "n_words",
    "mean_word",
    "symbol_share",
    "dup_line_share",
    "repeat_share",
    "capital_share",
    "exclaim_share",
    "digit_share",
    "distinct_share",
    "mean_line",
)


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.statistic)
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


def _covered_words(keys: Column) -> Column:
    """Words in windows whose key occurs twice or more; keys are those of the 5-word windows in order."""

    def count(positions: Column) -> Column:
        # Each window adds the words that the next one does not.
        following = F.concat(F.slice(positions, 2, F.size(positions)), F.array(F.element_at(positions, -1) + 5))
        gaps = F.zip_with(positions, following, lambda a, b: F.least(b - a, F.lit(5)))
        return F.aggregate(gaps, F.lit(0), lambda n, g: n + g)

    def positions(ordered: Column) -> Column:
        n = F.size(ordered)
        twice = F.filter(
            ordered,
            lambda x, i: ((i > 0) & (F.get(ordered, i - 1)["k"] == x["k"]))
            | ((i < n - 1) & (F.get(ordered, i + 1)["k"] == x["k"])),
        )
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    ordered = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    return let(ordered, lambda s: let(positions(s), count))


def _repeat_words(words: Column) -> Column:
    def count(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - 5)
        keys = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(5)]))
        repeats = let(
            keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), 0).otherwise(_covered_words(k))
        )
        return F.when(F.size(w) < 5, 0).otherwise(repeats)

    # Bound once: a projection that the optimiser merges must not split the text again for each window.
    return let(words, count)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and STATISTICS.

    Words are what ASCII white space parts. A null text has no words: counts and shares of 0.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id",
        F.length("text").alias("chars"),
        F.length(F.regexp_replace("text", WORD, "")).alias("spaces"),
        # The few characters that are counted below; the rest goes in long runs.
        F.regexp_replace("text", r"[^#*$%&|<>!A-Z0-9]+", "").alias("marks"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
        F.array_remove(F.split("text", SPACES), "").alias("words"),
    )
    marks = lambda others: F.length(F.regexp_replace("marks", others, ""))
    rows = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        (F.col("chars") - F.col("spaces")).cast("long").alias("word_chars"),
        marks("[!A-Z0-9]+").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        marks("[^A-Z]+").alias("n_capitals"),
        marks("[^!]+").alias("n_exclaims"),
        marks("[^0-9]+").alias("n_digits"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        share("word_chars", "n_words").alias("mean_word"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_capitals", "word_chars").alias("capital_share"),
        share("n_exclaims", "word_chars").alias("exclaim_share"),
        share("n_digits", "word_chars").alias("digit_share"),
        share("n_distinct", "n_words").alias("distinct_share"),
        share("word_chars", "n_lines").alias("mean_line"),
    )


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """id, label of most labelled rows at most, chosen by a hash of the id; all of them if there are fewer."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(
        "id IS NOT NULL AND label IS NOT NULL"
    )
    hashed = known.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 30)))
    total = known.count()
    if total > most:  # a hash threshold first, so that ordering meets few rows
        hashed = hashed.where(F.col("h") < int((1 << 30) * min(1.0, 1.2 * most / total)))
    return hashed.orderBy("h", "id", "label").limit(most).select("id", "label")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Rule]:
    """Rules that tell bad rows (quality 0), in order. Without labels of both kinds there are none.

    Ids and labels choose and mark the training rows; no statistic depends on them.
    """
    # At most MAX_TRAINING_ROWS ids and labels: a bounded broadcast.
    sample = F.broadcast(labelled_sample(labels, id_col, "quality"))
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sample, "id")
    rows = statistics(chosen, "id", "text").join(sample, F.col("doc_id") == F.col("id"))
    # A few MB at most; computed once, for the quantiles and then for the counts.
    rows = written(rows.select("id", "label", *[F.col(s).cast("double").alias(s) for s in STATISTICS]))
    cuts = rows.agg(*[F.percentile_approx(s, [*QUANTILES], 10_000).alias(s) for s in STATISTICS]).first()
    seen = {s: sorted({float(x) for x in cuts[s] or []}) for s in STATISTICS}
    thresholds = {s: [(a + b) / 2 for a, b in zip(seen[s], seen[s][1:])] for s in STATISTICS}

    def bin_of(s: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, thresholds[s])), lambda t: F.col(s) > t)) if thresholds[s] else F.lit(0)

    half = (F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)) == 0).alias("grow")
    cells = (
        rows.select(half, (F.col("label") == 0).alias("bad"), *[bin_of(s).alias(s) for s in STATISTICS])
        .groupBy("grow", "bad", *STATISTICS)
        .count()
        .collect()
    )
    return cover([(r["grow"], r["bad"], tuple(r[s] for s in STATISTICS), r["count"]) for r in cells], thresholds)


def cover(cells: list[tuple[bool, bool, tuple[int, ...], int]], thresholds: dict[str, list[float]]) -> list[Rule]:
    """Sequential covering over counted combinations of bins: (grow, bad, bins, count)."""

    def holds(test, bins) -> bool:
        i, above, t = test
        return (bins[i] > t) == above

    def weigh(part, rule) -> tuple[int, int]:
        bad = good = 0
        for _, is_bad, bins, n in part:
            if all(holds(t, bins) for t in rule):
                bad, good = (bad + n, good) if is_bad else (bad, good + n)
        return bad, good

    def grown(part, barred: set[tuple[int, bool]]) -> list:
        rule, inside = [], part
        bad, good = weigh(inside, [])
        while good and len(rule) < MAX_CONDITIONS:
            # Counts of bad and good by bin give every threshold of a statistic in one pass.
            best = (0.0, None)
            for i, s in enumerate(STATISTICS):
                n = len(thresholds[s]) + 1
                p, q = [0] * n, [0] * n
                for _, is_bad, bins, count in inside:
                    (p if is_bad else q)[bins[i]] += count
                p_low = q_low = 0
                for t in range(n - 1):
                    p_low, q_low = p_low + p[t], q_low + q[t]
                    for above, a, b in ((False, p_low, q_low), (True, bad - p_low, good - q_low)):
                        if not rule and (i, above) in barred:
                            continue
                        if a >= MIN_COVER and a + b < bad + good:
                            gain = a * (math.log2(a / (a + b)) - math.log2(bad / (bad + good)))
                            if gain > best[0] + 1e-9:
                                best = (gain, (i, above, t))
            if best[1] is None:
                break
            rule.append(best[1])
            inside = [c for c in inside if holds(best[1], c[2])]
            bad, good = weigh(inside, [])
        return rule

    def precision(part, rule) -> float:
        bad, good = weigh(part, rule)
        return (bad + 1) / (bad + good + 1)

    rules: list[Rule] = []
    barred: set[tuple[int, bool]] = set()  # statistic and side; each try adds one or a rule, so tries are bounded
    while len(rules) < MAX_RULES:
        grow, prune = [c for c in cells if c[0]], [c for c in cells if not c[0]]
        if not any(c[1] for c in grow):
            break
        first = grown(grow, barred)
        # The prefix that is worth most on the other half: (bad - good) / (bad + good), the longer one on a tie.
        value = lambda r: (lambda w: (w[0] - w[1]) / max(1, sum(w)))(weigh(prune, r))
        rule = max((first[:n] for n in range(1, len(first) + 1)), key=lambda r: (value(r), len(r)), default=[])
        if not rule:
            break
        if min(precision(grow, rule), precision(prune, rule)) < MIN_PRECISION:
            barred.add(rule[0][:2])
            continue
        barred.clear()
        rules.append(tuple(Condition(STATISTICS[i], above, thresholds[STATISTICS[i]][t]) for i, above, t in rule))
        cells = [c for c in cells if not all(holds(t, c[2]) for t in rule)]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; 0 when none does: an ordered conditional expression."""
    column = None
    for number, rule in enumerate(rules, 1):
        test = rule[0].column()
        for condition in rule[1:]:
            test = test & condition.column()
        column = F.when(test, number) if column is None else column.when(test, number)
    return F.lit(0) if column is None else column.otherwise(0)


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, the base counts, base_failed, kept, rule (0: none).

    base_failed: fewer than 10 words, or more than 20 % of them in repeated 5-word windows. A document is kept if
    it has not base_failed and no rule holds. A null or empty text has no words and fails. Repeated rows are
    judged each; ties cannot arise, as the first rule that holds decides. Other columns are ignored.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return statistics(docs, id_col, text_col).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (verdict(rules) == 0)).alias("kept"),
        verdict(rules).alias("rule"),
    )


def keep_good(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, that judge keeps."""
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    judged = judge(packed, rules, "row", "text")
    # An outer generator, unlike a filter, is not pushed below the statistics, which would compute them twice.
    good = judged.select(F.explode_outer(F.array(F.when(F.col("kept"), F.col("doc_id")))).alias("row"))
    return good.where("row IS NOT NULL").select("row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, learn(docs, table(spark, sf_dir, "labels")))
