"""Toxicity: a support vector machine on a gapped subsequence kernel, with Nyström landmarks.

The kernel counts the character triples that two words share in order, gaps allowed: each gap costs a factor, so an
insult with inserted or missing characters stays near the insult. Words are learnt from labelled sentences, a
document inherits from its worst words. Because the machine is linear in the kernel's features, its landmarks fold
into one weight per triple, and a word is scored without visiting the landmarks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idveil.llm.common import crc_remainder, table, written

#: Labelled documents that are learnt from at most.
MAX_TRAINING_DOCS = 20_000
#: Words of each kind that the machine is trained on at most, and landmarks.
MAX_POSITIVE, MAX_NEGATIVE, LANDMARKS = 1_000, 20_000, 384
#: Least distinct sentences of a positive word, and least share of them that are from toxic documents.
MIN_SENTENCES, MIN_SHARE = 3, 0.6
#: Factor per skipped character, and characters that a triple spans at most.
DECAY, SPAN = 0.5, 6
#: Codes of characters: 0 the edge of a word, small letters and digits their own, others share what is left.
CODES = 128
#: Words whose score a worker remembers, at most.
REMEMBERED = 1_000_000

_OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def _code_table() -> np.ndarray:
    others = np.arange(0x110000, dtype=np.int64)
    table_ = 38 + (others * 2654435761 % (1 << 32) >> 8) % (CODES - 38)
    for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789"):
        table_[ord(c)] = 1 + i
    table_[0] = 0
    return table_


_CODE = _code_table()


def unit(word: str) -> str:
    """A word as the kernel sees it: small letters, without other characters at its ends."""
    w = word.lower()
    a, b = 0, len(w)
    while a < b and not w[a].isalnum():
        a += 1
    while b > a and not w[b - 1].isalnum():
        b -= 1
    return w[a:b]


def _triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of words: word, triple, value, one line for each distinct triple of a word."""
    flat = _CODE[np.frombuffer("".join(f"\0{w.replace(chr(0), '')}\0" for w in words).encode("utf-32-le", "replace"), np.uint32)]
    lengths = np.array([len(w) - w.count("\0") + 2 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    keys = []
    for a, b in _OFFSETS:
        n = len(flat) - b
        if n <= 0:
            continue
        inside = owner[:n] == owner[b:]
        triple = (flat[:n] * CODES + flat[a : a + n]) * CODES + flat[b:]
        keys.append(((owner[:n] * CODES**3 + triple) * 4 + (b - 2))[inside])
    if not keys:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    key = np.sort(np.concatenate(keys))
    value = DECAY ** (key & 3).astype(float)
    key >>= 2
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first] // CODES**3, key[first] % CODES**3, np.add.reduceat(value, first) if len(key) else value


def _unit_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features with the norm of each word's vector 1."""
    word, triple, value = _triples(words)
    norm = np.sqrt(np.bincount(word, weights=value * value, minlength=len(words)))
    return word, triple, value / norm[word]


def kernel(left: list[str], right: list[str]) -> np.ndarray:
    """Normalised kernel of two lists of words, through the triples of the right ones."""
    word, triple, value = _unit_features(right)
    used, place = np.unique(triple, return_inverse=True)
    dense = np.zeros((len(right), len(used)))
    dense[word, place] = value
    out = np.zeros((len(left), len(right)))
    for at in range(0, len(left), 2000):
        part = left[at : at + 2000]
        word, triple, value = _unit_features(part)
        where = np.minimum(np.searchsorted(used, triple), max(0, len(used) - 1))
        hit = used[where] == triple if len(used) else np.zeros(len(triple), bool)
        block = np.zeros((len(part), len(used)))
        block[word[hit], where[hit]] = value[hit]
        out[at : at + len(part)] = block @ dense.T
    return out


def train_machine(words: list[str], label: np.ndarray, landmarks: list[str], penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weight per triple and bias of the machine: squared hinge loss on Nyström features, by Newton steps."""
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    x = np.column_stack([kernel(words, landmarks) @ whiten, np.ones(len(words))])
    y = np.where(label, 1.0, -1.0)
    each = np.where(label, 0.5 / max(1, label.sum()), 0.5 / max(1, (~label).sum()))  # both kinds weigh the same
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-9
    for _ in range(30):
        margin = 1 - y * (x @ w)
        active = margin > 0
        gradient = ridge * w - 2 * x[active].T @ (each * y * margin)[active]
        hessian = np.diag(ridge) + 2 * (x[active].T * each[active]) @ x[active]
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    beta = whiten @ w[:-1]
    word, triple, value = _unit_features(landmarks)
    weights = np.bincount(triple, weights=value * beta[word], minlength=CODES**3)
    return weights.astype(np.float32), float(w[-1])


@dataclass(frozen=True)
class Toxicity:
    """weights, bias: of the word machine. doc: coefficients of a document's features and their constant."""

    weights: np.ndarray
    bias: float
    doc: np.ndarray

    def words(self, words: list[str]) -> np.ndarray:
        """Decision values of words; a word without characters has none of the machine's triples."""
        word, triple, value = _unit_features(words)
        return np.bincount(word, weights=self.weights[triple] * value, minlength=len(words)) + self.bias


def units(text: str) -> list[str]:
    """The words of a text, and each run of three single characters or more as one word besides."""
    out = [u for w in text.split() if (u := unit(w))]
    run: list[str] = []
    more = []
    for u in [*out, ""]:
        if len(u) == 1:
            run.append(u)
            continue
        if len(run) > 2:
            more.append("".join(run))
        run = []
    return out + more


def _spelt(words: list[str], kinds: np.ndarray) -> list[str]:
    """The runs that units() finds in a text of these words, by the kind of each word's unit: 0 empty, 1 one character, 2 more."""
    at = np.flatnonzero(kinds)
    alone = np.concatenate([[0], kinds[at] == 1, [0]])
    edges = np.flatnonzero(np.diff(alone))
    runs = zip(edges[::2].tolist(), edges[1::2].tolist())
    return ["".join(unit(words[i]) for i in at[a:b]) for a, b in runs if b - a > 2]


def _features(decisions: np.ndarray) -> tuple[float, float, float]:
    """Of a document: its worst word, its second worst occurrence, the logarithm of how many are on the toxic side."""
    if not len(decisions):
        return -1.0, -1.0, 0.0
    worst = float(decisions.max())
    second = float(np.partition(decisions, -2)[-2]) if len(decisions) > 1 else -1.0
    clip = lambda v: max(-1.5, min(1.5, v))
    return clip(worst), clip(second), math.log1p(float((decisions > 0).sum()))


def _document_features(rows: DataFrame, model: Toxicity, keep: str) -> DataFrame:
    """The columns named in keep (a schema), worst, second, many: whole texts, words scored once per worker."""
    shared = rows.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # CODES ** 3 floats: 8 MB
    names = [x.strip().split(" ")[0] for x in keep.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = Toxicity(*shared.value, np.zeros(0))
        place: dict[str, int] = {}
        value, kind = np.zeros(0, np.float32), np.zeros(0, np.int8)
        for f in frames:
            for at in range(0, len(f), 500):
                part = f[at : at + 500]
                texts = [t.split() for t in part["text"]]
                if len(place) > REMEMBERED:
                    place, value, kind = {}, value[:0], kind[:0]
                new = list({w for t in texts for w in t if w not in place})
                for i in range(0, len(new), 20_000):
                    some = [unit(w) for w in new[i : i + 20_000]]
                    got = machine.words(some)
                    # Characters put between letters: the word without them counts as well.
                    joined = ["".join(filter(str.isalnum, u)) for u in some]
                    other = np.array([k for k, (u, j) in enumerate(zip(some, joined)) if u != j], np.int64)
                    if len(other):
                        got[other] = np.maximum(got[other], machine.words([joined[k] for k in other]))
                    empty = np.array([not u for u in some], bool)
                    value = np.append(value, np.where(empty, -9.0, got).astype(np.float32))
                    kind = np.append(kind, np.array([min(len(u), 2) for u in some], np.int8))
                for w in new:
                    place[w] = len(place)
                rows_ = []
                for words in texts:
                    ids = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
                    decisions = value[ids]
                    kinds = kind[ids]
                    if np.count_nonzero(kinds == 1) > 2 and (more := _spelt(words, kinds)):
                        decisions = np.append(decisions, machine.words(more))
                    rows_.append(_features(decisions[decisions > -9.0]))
                out = pd.DataFrame(rows_, columns=["worst", "second", "many"])
                for name in reversed(names):
                    out.insert(0, name, part[name].to_numpy())
                yield out

    return rows.mapInPandas(run, f"{keep}, worst double, second double, many double")


def _sentence_counts(sample: DataFrame) -> DataFrame:
    """word, bad, good: distinct sentences of toxic and of other documents that hold the word.

    A sentence that both have counts as good, so copies and quotations teach nothing twice.
    """

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for f in frames:
            for at in range(0, len(f), 500):
                part = f[at : at + 500]
                found = [(s, y) for t, y in zip(part["text"], part["label"]) for s in re.split(r"[.!?\n]+", t) if s.strip()]
                yield pd.DataFrame(found, columns=["sentence", "label"]).drop_duplicates()

    def spell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            pairs = [(w, y) for s, y in zip(f["sentence"], f["label"]) for w in {*units(s)}]
            yield pd.DataFrame(pairs, columns=["word", "label"])

    sentences = sample.select("text", "label").mapInPandas(split, "sentence string, label int")
    one = sentences.groupBy("sentence").agg(F.min("label").alias("label"))
    words = one.mapInPandas(spell, "word string, label int")
    return words.groupBy("word").agg(
        F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good")
    )


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Toxicity:
    """The model of labelled documents (toxic 0 or 1; null labels are none). One kind of label only: a constant model.

    Ids and labels choose and mark the rows; nothing but the text becomes a feature.
    """
    from idveil.llm.quality_rules import labelled_sample

    # At most MAX_TRAINING_DOCS ids and labels: a bounded broadcast.
    chosen = F.broadcast(labelled_sample(labels, id_col, "toxic", MAX_TRAINING_DOCS))
    sample = written(
        docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .join(chosen, "id")
        .select("id", "text", F.col("label").cast("int").alias("label"))
    )
    totals = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad")).first()
    rate = (totals["bad"] + 1) / (totals["n"] + 2)
    constant = Toxicity(np.zeros(CODES**3, np.float32), -1.0, np.array([0.0, 0.0, 0.0, math.log(rate / (1 - rate))]))
    if not 0 < totals["bad"] < totals["n"]:
        return constant

    counts = written(_sentence_counts(sample))
    share = F.col("bad") / (F.col("bad") + F.col("good"))
    overall = counts.agg(F.sum("bad").alias("b"), F.sum("good").alias("g")).first()
    base = overall["b"] / max(1, overall["b"] + overall["g"])
    # How surprising the share is at the base rate: bad * log(share / base) + good * log((1 - share) / (1 - base)).
    surprise = F.col("bad") * F.log(share / base) + F.col("good") * F.log((1 - share + 1e-9) / (1 - base + 1e-9))
    scored = counts.withColumn("surprise", surprise)
    positive = (F.col("bad") >= MIN_SENTENCES) & (share >= max(MIN_SHARE, base)) & (F.col("surprise") > 7.0)
    toxic = [r["word"] for r in scored.where(positive).orderBy(F.desc("surprise"), "word").limit(MAX_POSITIVE).collect()]
    if not toxic:
        return constant
    others = scored.where(~positive & (F.col("good") > 0)).select("word")
    plain = [r["word"] for r in others.orderBy(F.xxhash64("word"), "word").limit(MAX_NEGATIVE // 2).collect()]
    rng = np.random.default_rng(0)

    def machine(negative: list[str]) -> tuple[np.ndarray, float]:
        half = min(len(toxic), LANDMARKS // 2)
        some = [negative[i] for i in rng.permutation(len(negative))[: LANDMARKS - half]]
        words = toxic + negative
        label = np.arange(len(words)) < len(toxic)
        return train_machine(words, label, toxic[:half] + some)

    # Second pass with the words of good sentences that the first machine finds worst.
    first = Toxicity(*machine(plain), np.zeros(4))
    hard = _document_features(others.selectExpr("word", "word AS text"), first, "word string")
    worst = [r["word"] for r in hard.orderBy(F.desc("worst"), "word").limit(MAX_NEGATIVE // 2).collect()]
    weights, bias = machine(list(dict.fromkeys(worst + plain)))
    model = Toxicity(weights, bias, np.zeros(4))

    rows = _document_features(sample.select("label", "text"), model, "label int").toPandas()
    x = np.column_stack([rows["worst"], rows["second"], rows["many"], np.ones(len(rows))])
    return Toxicity(weights, bias, _logistic(x, rows["label"].to_numpy(float)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) / len(y) + ridge * w
        hessian = (x.T * (p * (1 - p) + 1e-6)) @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def score(docs: DataFrame, model: Toxicity, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    A null or empty text is scored as one without words. A null id is held out. Repeated rows are scored each and
    alike; an empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(held_out, F.lit(True)).alias("held_out"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    features = _document_features(rows, model, f"doc_id {kind}, held_out boolean")
    a, b, c, d = (float(v) for v in model.doc)
    value = 1 / (1 + F.exp(-(a * F.col("worst") + b * F.col("second") + c * F.col("many") + d)))
    return features.select("doc_id", "held_out", value.alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn(docs, labels.where(crc_remainder(F.col("doc_id"), 5) != 0))
    return score(docs, model, crc_remainder(F.col("doc_id"), 5) == 0)
