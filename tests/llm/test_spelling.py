import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from idveil.llm import spelling as sp


def slow_counts(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % sp.DAMAGED == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 5:
                out[word] += 1
    return {w: n for w, n in out.items() if n >= 3}


def slow_variants(counts):
    """Near words by their common neighbours one deletion away; every candidate is compared in full."""
    at = {}
    for w in counts:
        for d in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            at.setdefault(d, []).append(w)

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: set() for w in counts}
    for group in at.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= 2 * n:
            form[w] = best
    out = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        out.add((w, f, root, n, len(near[w]), counts[f] if f else None))
    return out


def as_set(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_against_brute_force(spark, sf_dir, texts):
    want = slow_variants(slow_counts(texts.items()))
    got = as_set(sp.op13_spelling_variants(spark, sf_dir))
    assert got == want
    assert sum(1 for r in want if r[1]) > 10


def test_awkward_rows(spark, awkward, empty):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert as_set(sp.spelling_variants(awkward)) == slow_variants(slow_counts(rows))
    assert sp.spelling_variants(empty).count() == 0


@pytest.mark.parametrize("bucket", [1, 8, 1000])
def test_pairs_do_not_depend_on_the_cut(spark, bucket):
    """Few letters, so that chunks are shared by many words; ties of counts; very long words."""
    rng = random.Random(7)
    words = {"".join(rng.choices("abé", k=rng.randint(5, 8))): rng.choice([3, 3, 6, 7, 20, 50]) for _ in range(500)}
    long = "xy" * 3000
    words |= {long: 3, long + "z": 9, long[:100] + long[101:]: 40, "z" + long: 3}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    pairs = {(r["u"], r["v"]) for r in sp.near_words(df, bucket).collect()}
    got = {w: set() for w in words}
    for u, v in pairs:
        got[u].add(v)
        got[v].add(u)
    want = {r[0]: r[4] for r in slow_variants({w: n for w, n in words.items() if len(w) < 100})}
    assert {w: len(s) for w, s in got.items() if len(w) < 100} == want
    assert got[long] == set(words) & {long + "z", long[:100] + long[101:], "z" + long}
    if bucket == 8:
        short = {w: n for w, n in words.items() if len(w) < 100}
        df = spark.createDataFrame(list(short.items()), "word string, n long")
        assert as_set(sp.variants(df)) == slow_variants(short)


def test_hot_chunk_makes_no_quadratic_join(spark):
    """All words share their first half and length: candidates stay near the number of real pairs."""
    rng = random.Random(9)
    words = {"commonstart" + "".join(rng.choices("abcdefghij", k=11)) for _ in range(3000)}
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    size = F.char_length("word")
    rows = df.select("word", "n", size.alias("size"), F.lit(0).alias("longer"), F.lit(0).alias("start"), size.alias("end"))
    largest = []
    for _ in range(4):
        rows = sp._cut(rows.drop("key"))
        largest.append(rows.groupBy("key").count().agg(F.max("count")).first()[0])
    assert largest[0] == 3000 and largest[-1] < 100
    pairs = sp.near_words(df).collect()
    assert all(sum(a != b for a, b in zip(r["u"], r["v"])) == 1 for r in pairs)
