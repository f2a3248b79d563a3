"""Language-model scoring with a log-frequency Bloom filter of bigram counts.

Counts of tokens are exact: they are counted by Spark and joined to the tokens of each block of documents. Bigram counts
are kept quantised in a Bloom filter: a bigram with count c is inserted once for each level 1 .. 1 + log2(c), and
reading it probes level after level until one is missing. The filter grows with the distinct bigrams of the
corpus; it is built and broadcast in segments of bounded size, and a worker holds one at a time once all of them
are larger than it may keep.

P(w | v) = (c(v w) + strength * P1(w)) / (c(v) + strength), with P1(w) = (c(w) + 1) / (N + V + 1): Dirichlet smoothing
of the quantised bigram count by the add-one unigram.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idveil.llm.common import crc_remainder, table, written

#: Tokens of the corpus per segment of the filter; its distinct bigrams are at most as many.
SEGMENT_TOKENS = 3_000_000
#: Bits of the filter per inserted level, and probes per level: 2 % of absent bigrams are taken for present.
BITS_PER_LEVEL, PROBES = 8, 5
#: Filter bytes that a worker keeps in memory; beyond, it holds one segment at a time.
RESIDENT_BYTES = 256_000_000
#: Documents that are scored together.
BLOCK_DOCS = 2000
#: Distinct tokens or bigrams of a task that are counted in memory before they are passed on.
PASS_ON = 400_000
#: Weight of the unigram in the smoothed probability, in counts.
STRENGTH = 200.0

#: Not words: no word is empty or has a space.
END, START = b"", b" "
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def tokens(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, then one end."""
    return [*text.encode().lower().split(), END]


def _bigrams(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mix(_mix(first) * _M1 + second)


def _place(codes: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment and 32-bit key of bigram codes."""
    return ((codes >> np.uint64(32)) % np.uint64(segments)).astype(np.int64), codes.astype(np.uint32)


@dataclass(frozen=True)
class Model:
    """Exact token counts (token, c), their totals, and the filter's segments (segment, bits)."""

    counts: DataFrame
    train_tokens: int
    vocabulary: int
    segments: int
    filter: DataFrame


def token_counts(train: DataFrame) -> DataFrame:
    """token, c over all texts. Tasks pass on what they have counted, so hot tokens are combined before the shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for f in frames:
            for t in f["text"]:
                seen.update(tokens(t))
                if len(seen) > PASS_ON:
                    yield pd.DataFrame({"token": list(seen.keys()), "n": list(seen.values())})
                    seen = Counter()
        yield pd.DataFrame({"token": list(seen.keys()), "n": list(seen.values())})

    parts = train.select("text").mapInPandas(run, "token binary, n long")
    return parts.groupBy("token").agg(F.sum("n").alias("c"))


class Codes:
    """64-bit codes of tokens, remembered up to a bound."""

    def __init__(self, limit: int = 500_000):
        self.known, self.limit = {}, limit

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.array([known[w] for w in words], np.uint64)


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and their counts, small: differences byte plane by byte plane."""
    gaps = np.diff(keys, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zlib.compress(gaps.tobytes() + counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(2, 4, -1)
    both = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4")[..., 0]
    return np.cumsum(both[0], dtype=np.uint32), both[1]


def _levels(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)  # 1: 1, 2 to 3: 2, 4 to 7: 3, ...


def _probe(keys: np.ndarray, level: int, size: int, i: int) -> np.ndarray:
    """Places of the i-th bits of keys at a level."""
    code = _mix(keys.astype(np.uint64) + np.uint64(level * int(_M1) % (1 << 64)))
    step = (code >> np.uint64(32)) | np.uint64(1)
    return ((code + np.uint64(i) * step) % np.uint64(size)).astype(np.int64)


def filter_bits(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bytes of a filter that holds these keys at their levels."""
    levels = _levels(counts)
    size = max(64, -(-int(levels.sum()) * BITS_PER_LEVEL // 8) * 8)
    bits = np.zeros(size, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for i in range(PROBES):
            bits[_probe(keys[levels >= level], level, size, i)] = True
    return np.packbits(bits)


def filter_counts(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Counts by repeated membership probes, as the middle of the last level found (0: none)."""
    found, open_ = np.zeros(len(keys), np.int64), np.arange(len(keys))
    level = 1
    while len(open_) and level <= 64:
        open_ = _members(bits, keys, open_, level)
        found[open_] = level
        level += 1
    return np.where(found == 0, 0.0, np.where(found == 1, 1.0, 1.45 * 2.0 ** (found - 1)))


def _members(bits: np.ndarray, keys: np.ndarray, which: np.ndarray, level: int) -> np.ndarray:
    """Those of the keys, by place, that the filter has at a level."""
    for i in range(PROBES):
        at = _probe(keys[which], level, len(bits) * 8, i)
        which = which[(bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]
    return which


def bigram_filter(train: DataFrame, segments: int) -> DataFrame:
    """segment, bits: the log-frequency Bloom filter of all bigrams of the texts."""

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, held, size = Codes(), [], 0

        def passed_on() -> pd.DataFrame:
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            segment, keys = _place(found, segments)
            rows = []
            for s in np.unique(segment):
                own, n = keys[segment == s], counts[segment == s]
                order = np.argsort(own, kind="stable")
                rows.append((int(s), _packed(own[order], n[order])))
            return pd.DataFrame(rows, columns=["segment", "part"])

        for f in frames:
            for at in range(0, len(f), 500):
                texts = [tokens(t) for t in f["text"][at : at + 500]]
                flat = codes([w for t in texts for w in (START, *t)])
                starts = np.cumsum([0] + [len(t) + 1 for t in texts])
                pairs = _bigrams(flat[:-1], flat[1:])
                held.append(np.delete(pairs, starts[1:-1] - 1))  # not across documents
                size += len(pairs)
                if size > 2 * PASS_ON:
                    yield passed_on()
                    held, size = [], 0
        if held:
            yield passed_on()

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpacked(p) for p in f["part"]]
        keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        counts = np.bincount(where, weights=np.concatenate([n for _, n in parts])).astype(np.int64)
        return pd.DataFrame({"segment": [int(f["segment"].iloc[0])], "bits": [filter_bits(keys, counts).tobytes()]})

    parts = train.select("text").mapInPandas(gather, "segment int, part binary")
    return parts.groupBy("segment").applyInPandas(merge, "segment int, bits binary")


def fit(train: DataFrame) -> Model:
    """The model of the texts (column text, no nulls). Counts and filter are written tables; totals are all that the driver has."""
    counts = written(token_counts(train))
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    segments = 1 + totals["n"] // SEGMENT_TOKENS
    return Model(counts, totals["n"], totals["v"], segments, written(bigram_filter(train, segments)))


def score(docs: DataFrame, model: Model, strength: float = STRENGTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, score of documents (doc_id, held_out, text, no null texts).

    Blocks of documents meet the exact counts of their own tokens: one row per block and token, whatever its frequency.
    """
    spark = docs.sparkSession
    blocks = 1 + docs.count() // BLOCK_DOCS
    dealt = docs.select("doc_id", "held_out", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"))
    dealt = dealt.repartition(blocks, "block")

    def distinct(f: pd.DataFrame) -> pd.DataFrame:
        words = {w for t in f["text"] for w in tokens(t)}
        return pd.DataFrame({"block": int(f["block"].iloc[0]), "token": list(words)})

    own = dealt.groupBy("block").applyInPandas(distinct, "block int, token binary")
    own = own.join(model.counts, "token")

    # One segment at a time passes through the driver; its size is bounded by SEGMENT_TOKENS.
    shared, total = [], 0
    for row in model.filter.toLocalIterator():
        shared.append((row["segment"], spark.sparkContext.broadcast(np.frombuffer(row["bits"], np.uint8))))
        total += len(row["bits"])
    resident = total <= RESIDENT_BYTES
    log_all = math.log10(model.train_tokens + model.vocabulary + 1)
    all_, segments = model.train_tokens + model.vocabulary + 1, model.segments

    def run(f: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        place = {t: i for i, t in enumerate(known["token"])}
        count = np.append(known["c"].to_numpy(np.int64), 0)  # the last is for unknown tokens
        code = np.append(Codes(limit=1 << 60)(list(known["token"])), np.uint64(0)) if len(known) else np.zeros(1, np.uint64)
        texts = [tokens(t) for t in f["text"]]
        lengths = np.array([len(t) for t in texts])
        unknown = len(known)
        at = np.array([place.get(w, unknown) for t in texts for w in t], np.int64)
        starts = np.cumsum(lengths) - lengths
        before = np.empty_like(at)
        before[1:] = at[:-1]
        end = place.get(END, unknown)
        before[starts] = end  # a document begins as often as one ends
        c, c_before = count[at], count[before]
        code_before = code[before]
        code_before[starts] = xxhash.xxh3_64_intdigest(START)
        both = np.flatnonzero((c > 0) & (c_before > 0))
        pairs, where = np.unique(_bigrams(code_before[both], code[at[both]]), return_inverse=True)
        segment, keys = _place(pairs, segments)
        pair_counts = np.zeros(len(pairs))
        for s, bits in shared:
            mine = np.flatnonzero(segment == s)
            pair_counts[mine] = filter_counts(bits.value, keys[mine])
            if not resident and hasattr(bits, "_value"):
                del bits._value  # read again from the executor's disk when it is next needed
        c_both = np.zeros(len(at))
        c_both[both] = np.minimum(pair_counts[where], np.minimum(c[both], c_before[both]))
        log_base = np.log10(c + 1.0) - log_all
        log_p = np.log10((c_both + strength * (c + 1.0) / all_) / (c_before + strength))
        doc = np.repeat(np.arange(len(texts)), lengths)
        total_of = lambda x: np.bincount(doc, weights=x, minlength=len(texts))
        return pd.DataFrame(
            {
                "doc_id": f["doc_id"].to_numpy(),
                "held_out": f["held_out"].to_numpy(),
                "n_tokens": lengths,
                "n_known": total_of(c > 0).astype(np.int64),
                "base_score": total_of(log_base),
                "score": total_of(log_p),
            }
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        dealt.groupBy("block")
        .cogroup(own.groupBy("block"))
        .applyInPandas(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    )


def score_documents(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", strength: float = STRENGTH
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row, learning from the others.

    A null text is an empty one: its only token is the end. Rows with a null held_out (a null id) are scored and not
    learnt from, and count as held out. Repeated rows are learnt from and scored each. Without any training row all
    counts are 0. An empty table gives an empty result. Other columns are ignored.
    """
    held = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       F.coalesce(held_out, F.lit(True)).alias("held_out"))
    model = fit(held.where("NOT held_out").select("text"))
    return score(held, model, strength).select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_remainder(F.col("doc_id"), 7) == 2
    return score_documents(table(spark, sf_dir, "documents"), held_out)
