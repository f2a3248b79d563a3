import random

import numpy as np

from idveil.llm import shingle_join as j


def shingles(text, width):
    words = text.encode().lower().split()
    if not words:
        return frozenset()
    n = min(width, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(texts, width, percent):
    sets = {i: shingles(t, width) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted((len(s), i) for i, s in sets.items() if s)
    for a, (size, i) in enumerate(ids):
        for other, k in ids[a + 1 :]:
            if 100 * size < percent * other:
                break
            both = len(sets[i] & sets[k])
            if 100 * both >= percent * (size + other - both):
                x, y = find(i), find(k)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


def result(df, percent, width):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in j.near_duplicates(df, percent, width).collect()}


def test_equals_brute_force(spark, sf_dir, texts):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert result(df, 80, 5) == brute(texts, 5, 80)


def test_edited_copies(spark):
    """A large group around one text, at all distances about the threshold; the text itself is the hub or is missing."""
    rng = random.Random(2)
    whole = [f"w{rng.randint(0, 10**6)}" for _ in range(240)]
    texts = {}
    for i in range(160):
        words = list(whole)
        for _ in range(i % 9):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**6)}"
        texts[500 - i] = " ".join(words)
    for i in range(60):
        texts[1000 + i] = " ".join(f"y{rng.randint(0, 30)}" for _ in range(rng.randint(0, 40)))
    texts |= {2000: "one", 2001: "One", 2002: "one two", 2003: "", 2004: " \n", 2005: "two one"}
    for percent, width in ((90, 3), (80, 5), (50, 1)):
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        assert result(df, percent, width) == brute(texts, width, percent)
        some = {i: t for i, t in texts.items() if t != " ".join(whole)}
        df = spark.createDataFrame(list(some.items()), "doc_id long, text string")
        assert result(df, percent, width) == brute(some, width, percent)


def test_sketch_bounds():
    rng = np.random.default_rng(4)
    bands = j.Bands(90)
    for size in (1, 9, 10, 57, 300, 5000):
        for more in range(0, size // 9 + 1, max(1, size // 20)):
            assert bands.of(size + more) - bands.of(size) in (0, 1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
        b = np.unique(np.append(a[rng.integers(0, 31) :], rng.integers(0, 2**63, 3, dtype=np.uint64)))
        difference = len(np.setxor1d(a, b))
        assert np.count_nonzero(j._sketch(a, 2048) ^ j._sketch(b, 2048)) <= difference
        both = len(np.intersect1d(a, b))
        if 10 * both >= 9 * (len(a) + len(b) - both):
            assert np.intersect1d(j.piece_keys(a, bands), j.piece_keys(b, bands)).size
    folded = j._fold(np.packbits(j._sketch(a, 2048)).tobytes(), 512)
    assert (folded == np.packbits(j._sketch(a, 512))).all()


def test_awkward_rows(awkward, empty):
    rows = j.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    got = {r["doc_id"]: r["component_id"] for r in rows}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, None: None, 7: 7, 8: 7, 9: 9, 10: 10}
    assert j.near_duplicates(empty).count() == 0
    kept = j.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 5, None, 7, 9, 10]))


def test_components_of_a_long_chain(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    links = [(min(a, b), max(a, b)) for a, b in zip(order, order[1:])] + [(900, 901)]
    got = {r["id"]: r["component"] for r in j.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in order} | {900: 900, 901: 900}


def test_unlike_sets_do_not_meet():
    """Pieces with one shingle only differ too; the places of set bits are those of the sketch that is laid out."""
    rng = np.random.default_rng(6)
    bands = j.Bands(80)
    sets = [np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64)) for _ in range(300)]
    keys = np.concatenate([np.unique(j.piece_keys(s, bands)) for s in sets])
    assert len(keys) - len(np.unique(keys)) < 100
    for bits in (64, 1024):
        assert (j._set_bits(sets[0], bits) == np.flatnonzero(j._sketch(sets[0], bits))).all()


def test_buckets_of_two_are_not_compared_again(spark):
    """The hub of a bucket has met all others; pairs of other members are still open."""
    profiles = j._profiles(spark.createDataFrame([(i, f"a b c d e f g {i}") for i in range(5)], "doc_id long, text string"), 50, 1)
    shared = spark.createDataFrame([(1, 0), (1, 1), (2, 2), (2, 3), (2, 4)], "key long, rep long")
    labels = spark.createDataFrame([], "id long, component long")
    got = {(r["u"], r["v"]) for r in j._open_pairs(shared, profiles, labels, 50).collect()}
    assert got == {(2, 3), (2, 4), (3, 4)}
