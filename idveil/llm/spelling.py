"""Spelling variants: words one edit apart, found by asymmetric q-chunks, grouped under their most frequent forms.

Of two words one edit apart, the shorter one (of equal lengths, either) is cut into two disjoint chunks, and one edit
spoils one of them at most. The other word contributes its positional grams: of all its grams, only those can equal
a chunk that lie at the chunk's place or one after it. The join is on the chunk's place and text.

A chunk that many words share would make a large bucket. There the spoilt part is cut into two chunks again, and so on: every
step adds half of what is open to the key, and at the end one character is open, so that a bucket holds only words that
are variants of each other. Buckets of any size are thus joined whole, without comparing all of a chunk's words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idveil.llm.common import pair, table, written

#: Least length and number of occurrences of a word; a form is so many times as frequent.
MIN_LENGTH, MIN_COUNT, FORM_FACTOR = 5, 3, 2
#: One in so many words of a document loses a character.
DAMAGED = 97
#: Buckets with more words have their open part cut again.
BUCKET = 64
#: Distinct words that a task counts before it passes the counts on.
HELD = 500_000
#: Rows that may be broadcast.
MAX_BROADCAST = 200_000

#: A byte of Latin-1 is a code point; bytes lower-case A-Z only, and characters beyond Latin-1 become question marks.
_RUN = re.compile(rb"[a-z\xc0-\xff]+")


def runs(text: str) -> list[bytes]:
    """Runs of letters of a text, A-Z in lower case, as Latin-1."""
    return _RUN.findall(text.encode("latin-1", "replace").lower())


def damaged(doc_id: str, word: bytes, modulus: int) -> bytes:
    """The word, without one of its characters if the hash of document and word says so."""
    plain = word if word.isascii() else word.decode("latin-1").encode()
    h = zlib.crc32(plain, zlib.crc32(f"{doc_id}:".encode()))
    if h % modulus:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    modulus: int = DAMAGED,
) -> DataFrame:
    """word, n of the words of whole texts, with min_length code points and min_count occurrences or more.

    A null text has no words, a null id is written as empty text. Every row counts, repeated ones too.
    """
    rows = pair(docs, id_col, text_col).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[bytes] = Counter()

        def passed_on() -> pd.DataFrame:
            out = pd.DataFrame({"word": [w.decode("latin-1") for w in counts], "n": list(counts.values())})
            counts.clear()
            return out

        for f in frames:
            for doc_id, text in zip(f["id"], f["text"]):
                for word, n in Counter(runs(text)).items():
                    if len(word) >= min_length:
                        word = damaged(doc_id, word, modulus)
                        if len(word) >= min_length:
                            counts[word] += n
                if len(counts) > HELD:
                    yield passed_on()
        if counts:
            yield passed_on()

    return (
        rows.mapInPandas(run, "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= min_count)
    )


def _key(word: Column, size: Column, start: Column, end: Column, longer: Column) -> Column:
    """Hash of the place of the open part and of what lies before and after it (one later in the longer word)."""
    return F.xxhash64(size, start, end, word.substr(F.lit(1), start), word.substr(end + longer + 1, F.char_length(word)))


def _cut(rows: DataFrame) -> DataFrame:
    """rows with their open part (start to end of a word of that size) cut in two: one of both is the new open part."""
    middle = F.floor((F.col("start") + F.col("end")) / 2).cast("int")
    halves = F.array(F.struct(F.col("start").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("end").alias("b")))
    cut = rows.withColumn("half", F.explode(halves))
    key = _key(F.col("word"), F.col("size"), F.col("half.a"), F.col("half.b"), F.col("longer"))
    return cut.select("word", "n", "size", "longer", F.col("half.a").alias("start"), F.col("half.b").alias("end"), key.alias("key"))


def _few(rows: DataFrame) -> DataFrame:
    """rows for a broadcast if there are few of them; else as they are."""
    return F.broadcast(rows) if rows.count() <= MAX_BROADCAST else rows


def near_words(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """u, n_u, v, n_v: pairs of words (word, n; distinct) that differ by one inserted, deleted or replaced code point, once each.

    u is the shorter word, of equal lengths the smaller. Which buckets are cut again changes the work, not the pairs.
    """
    size = F.char_length("word")
    # As chunks of its own length, which are also the grams for that length, and as grams for the length below.
    roles = F.explode(F.array(F.lit(0), F.lit(1))).alias("longer")
    rows = words.select("word", "n", size.alias("length"), roles).where("length > longer")
    rows = rows.select("word", "n", (F.col("length") - F.col("longer")).alias("size"), "longer")
    rows = written(_cut(rows.withColumn("start", F.lit(0)).withColumn("end", F.col("size"))))
    small = []
    while True:
        # Chunks without a partner leave: a bucket needs a chunk, and another word.
        chunks, number = F.count_if(F.col("longer") == 0), F.count(F.lit(1))
        sizes = written(
            rows.groupBy("key")
            .agg(chunks.alias("chunks"), number.alias("number"), F.max(F.col("end") - F.col("start")).alias("open"))
            .where("chunks > 0 AND number > 1")
            .select("key", ((F.col("number") > bucket) & (F.col("open") > 1)).alias("large"))
        )
        large = sizes.where("large").select("key")
        # AQE splits a hot bucket: the side of the sizes has one row for it.
        small.append(rows.join(sizes.where("NOT large").select("key"), "key"))
        if not large.limit(1).count():
            break
        rows = written(_cut(rows.join(_few(large), "key").drop("key")))
    pairs = []
    for part in small:
        part = part.select("key", "word", "n", "longer")
        u = part.where("longer = 0").select("key", F.col("word").alias("u"), F.col("n").alias("n_u"))
        v = part.select("key", F.col("word").alias("v"), F.col("n").alias("n_v"), "longer")
        near = ((F.col("longer") == 1) | (F.col("u") < F.col("v"))) & (F.levenshtein("u", "v", 1) == 1)
        pairs.append(u.join(v, "key").where(near).select("u", "n_u", "v", "n_v"))
    found = pairs[0]
    for more in pairs[1:]:
        found = found.unionAll(more)
    return found.distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: forms (word, form) followed to the last, twice as far in each round. Counts double at each form, so few are chained."""
    at = written(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = written(at.select("word", "root").join(_few(ahead), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not at.where("moved").limit(1).count():
            return at.select("word", "root")


def variants(words: DataFrame, factor: int = FORM_FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of each of words (word, n; distinct).

    form is the near word of largest n (ties: smallest in code-point order) if that is factor times the word's n or
    more, else null; root the last of the forms that follow from the word (itself, if none). An empty table gives an empty result.
    """
    words = written(words.select("word", "n"))
    pairs = written(near_words(words))
    both = pairs.selectExpr("u AS word", "v AS other", "n_v AS n_other").unionAll(
        pairs.selectExpr("v AS word", "u AS other", "n_u AS n_other")
    )
    best = F.min(F.struct((-F.col("n_other")).alias("minus"), "other")).alias("best")
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    enough = -F.col("best.minus") >= factor * F.col("n")
    rows = written(
        words.join(near, "word", "left").select(
            "word",
            F.when(enough, F.col("best.other")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(enough, -F.col("best.minus")).alias("form_n"),
        )
    )
    roots = _roots(rows.where("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = DAMAGED) -> DataFrame:
    """The variants of the words of docs. Nulls and repeated rows as in word_counts; words of any length; an empty table,
    or one without frequent words, gives an empty result; other columns are ignored."""
    return variants(word_counts(docs, id_col, text_col, modulus=modulus))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
