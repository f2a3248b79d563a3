import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from idveil.llm import prefix_trie as pt


def slow_trie(rows):
    """rows (conv_id, turn, role, text): every beginning with its members."""
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs.setdefault(conv, []).append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t[-1] for t in sorted(ts)] for c, ts in convs.items()}
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
    members = {}
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) or 1
        last = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * last + sum(saved[x] for x in below)
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(seqs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(who), len(node), parent, len(who), len(children.get(node, [])), leaves[node], saved[node], sha))
    return out


def result(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def invented(seed, convs, texts, longest):
    """Conversations over few texts, many of them copies or beginnings of each other."""
    rng = random.Random(seed)
    rows, made = [], []
    for c in rng.sample(range(convs * 3), convs):
        seq = [(rng.choice("ua"), " ".join("x" * rng.randint(1, texts))) for _ in range(rng.randint(1, longest))]
        if made and rng.random() < 0.6:
            seq = list(rng.choice(made))[: rng.randint(1, longest)]
        made.append(seq)
        rows += [(c, t, *s) for t, s in enumerate(seq)]
    rng.shuffle(rows)
    return rows


def test_query_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(pt.op11_prefix_trie(spark, sf_dir)) == sorted(slow_trie(rows), key=repr)


@pytest.mark.parametrize("seed, batch, fan_in, partitions", [(1, 10_000, 16, 4), (2, 3, 2, 7), (3, 1, 3, 40), (4, 2, 2, 1)])
def test_any_blocks_and_rounds_give_the_same(spark, monkeypatch, seed, batch, fan_in, partitions):
    """Nodes and copies that span blocks, tasks and groups of tasks."""
    rows = invented(seed, 150, 3, 6)
    monkeypatch.setattr(pt, "FAN_IN", fan_in)
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        assert result(pt.prefix_trie(df)) == sorted(slow_trie(rows), key=repr)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_odd_rows(spark):
    rows = [
        (0, 1, "user", "a b"),
        (0, None, None, None),
        (0, 1, "user", "a b"),  # repeated
        (0, 1, "assistant", ""),  # a tie
        (1, 0, "us", "era b"),
        (1, 5, "user", "long " * 5000),
        (None, 0, "user", "no conversation"),
        (7, None, "", ""),
        (21, 0, "x", "its family has no first one"),
        (20 + 17, 0, "x", "y"),
        (-3, 0, "user", "a b"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ["key", "digests", "turns", "family", "place"]:
        df = df.withColumn(name, F.lit("clash"))
    # The remainder of a negative number is negative here, as in SQL.
    want = slow_trie([r for r in rows if r[0] is None or r[0] >= 0])
    assert result(pt.prefix_trie(df.where("conv_id >= 0"))) == sorted(want, key=repr)
    assert pt.prefix_trie(df).where("depth = 0").first()["n_convs"] == 6
    assert pt.prefix_trie(df.where("false")).count() == 0


def test_digests_keep_role_and_text_apart(spark):
    df = spark.createDataFrame([("us", "er"), ("user", ""), ("", "user")], "r string, t string")
    assert df.select(pt.turn_digest(F.col("r"), F.col("t")).alias("d")).distinct().count() == 3
