import random

import numpy as np
from pyspark.sql import functions as F

from idveil.llm import language_id as li
from tests.llm.conftest import crc


def slow_subwords(text):
    """Runs of 2 to 4 characters inside words, each word between two edges."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = []
    for n in li.LENGTHS:
        for w in words:
            w = f"\0{w}\0"
            out += [w[i : i + n] for i in range(len(w) - n + 1)]
    return out


def slow_bucket(piece):
    top = 1 << 64
    h = sum(ord(c) * int(f) for c, f in zip(piece, li._FACTORS)) + len(piece)
    h = h * int(li._MIX) % top
    h = (h ^ (h >> 29)) * int(li._FACTORS[1]) % top
    return h >> (64 - li.LG_BUCKETS)


def test_subwords_equal_their_definition():
    for text in ["", "a", "Ab c", "  été, straße-x!! 日本 a1b ", "x" * 50, "..", "İI"]:
        want = sorted(slow_bucket(p) for p in slow_subwords(text))
        assert sorted(li._subwords(li._codes(text))[0].tolist()) == want, text


def test_steps_add_up_to_whole_texts(monkeypatch):
    rng = np.random.default_rng(1)
    model = li.Languages(["a", "b"], rng.normal(size=(1 << li.LG_BUCKETS, 3)).astype(np.float32), np.zeros(2))
    texts = ["", "one two", "drei vier fünf " * 40, "..", "x"]
    want = [model.rows[[slow_bucket(p) for p in slow_subwords(t)]].sum(axis=0) for t in texts]
    for cells in (3, 30, 1000, 1_000_000):
        monkeypatch.setattr(li, "CELLS", cells)
        sums, number = model.sums(texts)
        assert np.allclose(sums, want, atol=1e-3)
        assert number.tolist() == [len(slow_subwords(t)) for t in texts]


SYLLABLES = {"aa": "ba ke lo mi nu ra", "bb": "sch ung ein ver ich", "cc": "ción que los par ada", "dd": "жи ло на ра сы"}


def invented(rng, lang, words):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(words))


def test_held_out_rejection_and_odd_rows(spark, awkward, empty):
    rng = random.Random(5)
    rows = [(i, lang, invented(rng, lang, 20)) for i, lang in enumerate(list(SYLLABLES) * 120)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = li.learn(docs.where(remainder != 2))
    found = li.identify(docs, model, remainder == 2).collect()
    truth = {i: lang for i, lang, _ in rows}
    held = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if crc(i, 4) == 2}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert sum(r["accepted"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found)

    # Another language and another script are rejected.
    strange = spark.createDataFrame([(1, "wyk zwo gryf plox kwyj " * 5), (2, "αβγ δεζ ηθι " * 5), (3, invented(rng, "aa", 30))], "doc_id long, text string")
    lang = {r["doc_id"]: r["lang_pred"] for r in li.identify(strange, model, F.lit(False), reject=True).collect()}
    assert lang == {1: "und", 2: "und", 3: "aa"}

    odd = li.identify(awkward, model, F.lit(None).cast("boolean"))
    assert odd.columns == ["doc_id", "held_out", "lang_pred", "score", "accepted"]
    odd = odd.collect()
    assert len(odd) == awkward.count()
    assert {r["doc_id"] for r in odd if r["lang_pred"] == "und"} == {1, 2, 3}
    assert len({r["score"] for r in odd if r["doc_id"] == 6}) == 1
    assert li.identify(empty, model, F.lit(True)).count() == 0


def test_few_or_no_labels(spark, awkward):
    none = awkward.withColumn("lang", F.lit(None).cast("string"))
    assert li.learn(none) is None
    assert {r["lang_pred"] for r in li.identify(none, None, F.lit(True)).collect()} == {"und"}
    one = li.learn(awkward.withColumn("lang", F.lit("en")))
    assert {r["lang_pred"] for r in li.identify(awkward, one, F.lit(True)).collect()} == {"en", "und"}
    # Repeated rows are one row of the sample.
    rows = li.labelled_bags(awkward.selectExpr("xxhash64(doc_id, text) AS key", "'x' AS lang", "coalesce(text, '') AS text"))
    assert len(rows) == 11


def test_query_on_held_out_documents(spark, sf_dir):
    rows = li.op12_language_id(spark, sf_dir).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and {r["doc_id"] for r in held} == {i for i in lang if crc(i, 4) == 2}
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.9 * len(held)
