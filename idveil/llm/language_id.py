"""Language identification: averaged embeddings of hashed subwords under a linear softmax, with calibrated rejection.

A text is the mean of the embeddings of its subwords (runs of two to four characters inside words, edges marked). The
embeddings and the softmax are learnt together by stochastic gradient descent in numpy on a bounded sample. As the
model is linear in the mean, embeddings and softmax fold into one row of class values per bucket, and a text of any
length is scored by adding rows. A part of the sample that is not learnt from sets the temperature of the scores,
and the limits under which a prediction is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idveil.llm.common import crc_remainder, table

#: Labelled documents that are learnt from, about: each language gets an equal part, or all its documents if fewer.
MAX_TRAINING_DOCS = 8_000
#: Languages that are learnt, the most frequent ones.
MAX_LANGUAGES = 200
#: One in so many documents of the sample calibrates instead of being learnt from.
CALIBRATION = 5
#: Buckets of the subword hash (a power of two), embedding size, lengths of subwords.
LG_BUCKETS, DIM, LENGTHS = 16, 16, (2, 3, 4)
EPOCHS, RATE = 6, 0.5
#: A prediction is accepted where those with its score or more are right so often in calibration documents,
#: and where it has as many known subwords as all but the last share of calibration documents.
PRECISION, STRANGE = 0.99, 0.005
#: Language of a text without a letter, or that is rejected.
UNDETERMINED = "und"
#: Cells of the intermediate arrays of one step.
CELLS = 8_000_000

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    out = np.zeros(0x110000, bool)
    out[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return out


def _codes(text: str) -> np.ndarray:
    """Code points of the small letters; 0 for each run of other characters, and at both ends."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[codes], codes, 0)
    keep = codes != 0
    keep[0] = True
    keep[1:] |= codes[:-1] != 0
    return codes[keep].astype(np.uint64)


def _subwords(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and first place of each subword: an edge of a word may only be at its ends."""
    buckets, places = [], []
    inner = codes != 0
    value = codes * _FACTORS[0]
    for n in range(2, max(LENGTHS) + 1):
        count = len(codes) - n + 1
        if count <= 0:
            break
        value = value[:count] + codes[n - 1 :] * _FACTORS[n - 1]
        if n not in LENGTHS:
            continue
        whole = inner[:count] | inner[1:] if n == 2 else inner[1 : count + 1]
        for i in range(2, n - 1):
            whole = whole & inner[i : count + i]
        at = np.flatnonzero(whole)
        mixed = (value[at] + np.uint64(n)) * _MIX
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _FACTORS[1]
        buckets.append((mixed >> np.uint64(64 - LG_BUCKETS)).astype(np.int32))
        places.append(at)
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(places)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text's subwords, and the share of each."""
    buckets, times = np.unique(_subwords(_codes(text))[0], return_counts=True)
    return buckets, (times / max(1, times.sum())).astype(np.float32)


@dataclass
class Languages:
    """names; per bucket: one value per language, and 1 if it was learnt from; temperature and limits of acceptance."""

    names: list[str]
    rows: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    min_score: float = 0.0
    min_known: float = 0.0

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the rows of each text's subwords, and their number. A step holds CELLS cells, whatever a text's length."""
        out = np.zeros((len(texts), self.rows.shape[1]))
        number = np.zeros(len(texts), np.int64)
        step, most = max(1, CELLS // self.rows.shape[1]), max(LENGTHS)
        for i, text in enumerate(texts):
            codes = _codes(text)
            for at in range(0, len(codes), step):
                buckets, places = _subwords(codes[at : at + step + most - 1])
                if len(codes) > step:
                    buckets = buckets[places < step]  # those that begin later belong to the next step
                out[i] += np.ones(len(buckets), np.float32) @ self.rows[buckets]
                number[i] += len(buckets)
        return out, number

    def predict(self, texts: list[str]) -> pd.DataFrame:
        """lang, score (calibrated), accepted of each text."""
        sums, number = self.sums(texts)
        mean = sums / np.maximum(number, 1)[:, None]
        p = _softmax((mean[:, :-1] + self.bias) / self.temperature)
        best, score, found = p.argmax(axis=1), p.max(axis=1), number > 0
        accepted = found & (score >= self.min_score) & (mean[:, -1] >= self.min_known)
        lang = np.where(found, np.array(self.names, object)[best], UNDETERMINED)
        return pd.DataFrame({"lang": lang, "score": np.where(found, score, 0.0), "accepted": accepted})


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, names: list[str], seed: int = 0) -> Languages:
    """Embeddings and softmax by gradient descent, one text after another; the step shrinks to nothing."""
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-0.5, 0.5, (1 << LG_BUCKETS, DIM)).astype(np.float32)
    weights = np.zeros((len(names), DIM), np.float32)
    bias = np.zeros(len(names), np.float32)
    known = np.zeros(1 << LG_BUCKETS, np.float32)
    steps, total = 0, EPOCHS * len(bags)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            buckets, share = bags[i]
            steps += 1
            if not len(buckets):
                continue
            rate = np.float32(RATE * (1 - steps / total))
            vectors = embed[buckets]
            hidden = share @ vectors
            error = _softmax(weights @ hidden + bias)
            error[labels[i]] -= 1
            # A share is small; the step of a bucket is in proportion to it, the largest as large as the weights' own.
            embed[buckets] = vectors - rate * np.outer(share / share.max(), error @ weights)
            weights -= rate * np.outer(error, hidden)
            bias -= rate * error
            known[buckets] = 1
    return Languages(list(names), np.column_stack([embed @ weights.T, known]).astype(np.float32), bias)


def calibrate(model: Languages, bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Languages:
    """The model with the temperature under which its scores fit these texts best, and the limits of acceptance."""
    used = [i for i, (b, _) in enumerate(bags) if len(b)]
    if not used:
        return model
    mean = np.stack([bags[i][1] @ model.rows[bags[i][0]] for i in used]).astype(np.float64)
    truth = labels[used]

    def loss(temperature: float) -> float:
        p = _softmax((mean[:, :-1] + model.bias) / temperature)
        return -np.log(np.maximum(p[np.arange(len(truth)), truth], 1e-12)).mean()

    temperature = min(np.geomspace(0.05, 20, 121), key=loss)
    p = _softmax((mean[:, :-1] + model.bias) / temperature)
    order = np.argsort(-p.max(axis=1), kind="stable")
    right = np.cumsum(p.argmax(axis=1)[order] == truth[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(right >= PRECISION)
    min_score = float(p.max(axis=1)[order][good[-1]]) if len(good) else 1.0
    min_known = float(np.quantile(mean[:, -1], STRANGE))
    return Languages(model.names, model.rows, model.bias, float(temperature), min_score, min_known)


def labelled_bags(docs: DataFrame, max_docs: int = MAX_TRAINING_DOCS) -> pd.DataFrame:
    """lang, buckets, shares (as bytes) of a sample of docs (key, lang, text): about max_docs rows, alike for every language.

    Whether a row is in the sample depends on its key and its language's number of rows only. Rows that repeat a key
    count once. The number of distinct buckets bounds a row, however long its text.
    """
    often = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    counts = {r["lang"]: r["n"] for r in often.collect()}
    if not counts:
        return pd.DataFrame(columns=["lang", "calibrates", "buckets", "shares"])
    rates = {lang: min(1.0, max_docs / len(counts) / n) for lang, n in counts.items()}
    rate = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])
    place = F.pmod(F.shiftrightunsigned("key", 8), F.lit(1 << 40)) / float(1 << 40)
    chosen = docs.where(F.col("lang").isin(*rates)).where(place < F.element_at(rate, F.col("lang")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 200):
                part = f[at : at + 200]
                bags = [bag(t) for t in part["text"]]
                yield pd.DataFrame(
                    {
                        "key": part["key"],
                        "lang": part["lang"],
                        "buckets": [b.astype("<i4").tobytes() for b, _ in bags],
                        "shares": [s.astype("<f4").tobytes() for _, s in bags],
                    }
                )

    one = chosen.dropDuplicates(["key"]).select("key", "lang", "text")
    rows = one.mapInPandas(run, "key long, lang string, buckets binary, shares binary").toPandas()
    rows = rows.sort_values(["key"], ignore_index=True)
    rows["calibrates"] = rows["key"] % CALIBRATION == 0
    return rows


def learn(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_TRAINING_DOCS
) -> Languages | None:
    """The model of the rows of docs with a language and a letter; None if there are none.

    Ids and languages choose and mark the rows; nothing but the text becomes a feature.
    """
    rows = docs.select(
        F.xxhash64(F.col(id_col), F.col(text_col), F.col(lang_col)).alias("key"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).alias("text"),
    )
    sample = labelled_bags(rows.where("lang IS NOT NULL AND text RLIKE '\\\\p{L}'"), max_docs)
    if not len(sample):
        return None
    names = sorted(sample["lang"].unique())
    labels = sample["lang"].map({x: i for i, x in enumerate(names)}).to_numpy()
    bags = [(np.frombuffer(b, "<i4"), np.frombuffer(s, "<f4")) for b, s in zip(sample["buckets"], sample["shares"])]
    held = sample["calibrates"].to_numpy()
    if len(set(labels[~held])) < len(names):  # too few to spare any
        held = np.zeros(len(bags), bool)
    model = train([b for b, h in zip(bags, held) if not h], labels[~held], names)
    return calibrate(model, [b for b, h in zip(bags, held) if h], labels[held])


def identify(
    docs: DataFrame, model: Languages | None, held_out: Column, id_col: str = "doc_id", text_col: str = "text", reject: bool = False
) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of every row.

    lang_pred is a learned language, or `und` if the text is null, empty or without a letter, or no model was learnt
    (score 0). score is the calibrated probability of lang_pred. accepted is false for a score or a share of known
    subwords under the calibrated limits; with reject, lang_pred is then `und`. Whole texts count, however long. A null
    id is not held out. Repeated rows are scored each and alike; an empty table gives an empty result. Other columns
    are ignored.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    if model is None:
        return rows.select(
            "doc_id", "held_out", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted")
        )
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** LG_BUCKETS rows of MAX_LANGUAGES + 1 at most

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 500):
                part = f[at : at + 500]
                found = shared.value.predict(list(part["text"]))
                found.index = part.index
                if reject:
                    found["lang"] = found["lang"].where(found["accepted"], UNDETERMINED)
                yield pd.concat([part[["doc_id", "held_out"]], found.rename(columns={"lang": "lang_pred"})], axis=1)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, accepted boolean")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = crc_remainder(F.col("doc_id"), 4)
    return identify(docs, learn(docs.where(remainder != 2)), remainder == 2)
