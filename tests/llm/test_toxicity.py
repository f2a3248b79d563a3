import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from idveil.llm import toxicity as t


def slow_kernel(a, b):
    def features(word):
        word = f"\0{word}\0"
        out = {}
        for i in range(len(word)):
            for j in range(i + 1, len(word)):
                for k in range(j + 1, min(len(word), i + t.SPAN)):
                    key = tuple(int(t._CODE[ord(c)]) for c in (word[i], word[j], word[k]))
                    out[key] = out.get(key, 0) + t.DECAY ** (k - i - 2)
        return out

    x, y = features(a), features(b)
    dot = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
    return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5


def test_kernel_equals_its_definition():
    words = ["idiot", "i.d.i.o.t", "idiooot", "radio", "été", "aaaa", "xyzzy1", "moron"]
    got = t.kernel(words, words)
    want = np.array([[slow_kernel(a, b) for b in words] for a in words])
    assert np.allclose(got, want)
    assert got[0, 2] > 2 * got[0, 3]  # repeated letters stay nearer than another word of the same letters


INSULTS = ["blockhead", "nitwit", "dunderpate", "numskull"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    syllables = "ba ke lo mi nu ra te so vi do ga".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    rows = []
    for i in range(500):
        sentences = [" ".join(word() for _ in range(8)) + "." for _ in range(4)]
        toxic = int(i % 4 == 0)
        if toxic:
            sentences[rng.randrange(4)] = f"{word()} {word()} {rng.choice(INSULTS)} {word()} {word()}."
        rows.append((i, " ".join(sentences), toxic))
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5], "doc_id long, toxic int")
    return docs, labels, {i: y for i, _, y in rows}


def test_held_out_and_obfuscated(spark, corpus, awkward, empty):
    docs, labels, truth = corpus
    model = t.learn(docs, labels)
    held = F.col("doc_id") % 5 == 0
    rows = t.score(docs, model, held).collect()
    right = [r["predicted"] == truth[r["doc_id"]] for r in rows if r["held_out"]]
    assert sum(right) >= 0.97 * len(right)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    odd = ["lami rake block-head soso", "raso ni.tw.it! teba", "you n u m s k u l l teba", "nuumskull, lami", "DUNDERPATE"]
    clean = ["lami rake soso", "", None, "block of heads", "a b c d e", "numbers skulk"]
    df = spark.createDataFrame(list(enumerate(odd + clean)), "doc_id long, text string")
    got = [r["score"] for r in t.score(df, model, F.lit(False)).orderBy("doc_id").collect()]
    assert min(got[: len(odd)]) > max(got[len(odd) :])
    assert t.score(awkward, model, held).count() == awkward.count()
    assert t.score(empty, model, held).count() == 0
    # Copies score alike; ids are no input.
    assert len({r["score"] for r in t.score(awkward.where("doc_id = 6"), model, held).collect()}) == 1


def test_nothing_to_learn(corpus, empty):
    docs, labels, _ = corpus
    for some in (labels.where("false"), labels.where("toxic = 1")):
        model = t.learn(docs, some)
        assert len({r["score"] for r in t.score(docs, model, F.lit(True)).collect()}) == 1
    t.learn(empty, labels)


def test_spelt_runs_without_taking_words_apart_again():
    """The runs of single characters, from the kinds of the words alone: as units() finds them."""
    rng = random.Random(9)
    for _ in range(500):
        words = "".join(rng.choices(["a ", "B. ", "-- ", "é ", "bake ", "no! ", "(7) "], k=rng.randint(0, 30))).split()
        kinds = np.array([min(2, len(t.unit(w))) for w in words], np.int8)
        plain = [u for w in words if (u := t.unit(w))]
        assert t._spelt(words, kinds) == t.units(" ".join(words))[len(plain) :]
