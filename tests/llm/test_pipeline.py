import re

import corpus_pipeline as p
from idveil.llm import packing, quality_rules
from idveil.llm.common import table

from .test_line_dedup import brute as brute_lines
from .test_quality_rules import BASE, brute as brute_counts
from .test_secrets import base as brute_spans
from .test_shingle_join import brute as brute_groups


def test_stages_take_effect_in_order(spark, sf_dir):
    """Each stage against brute force, on its own input."""
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns

    kept = p.quality(spark, docs, sf_dir)
    assert kept.columns == columns
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    rule = {r["doc_id"]: r["rule"] for r in quality_rules.judge(docs, rules).collect()}
    rows = docs.collect()
    want = {r["doc_id"] for r in rows if not brute_counts(r["text"] or "")[BASE.index("base_failed")] and not rule[r["doc_id"]]}
    got = kept.collect()
    assert {r["doc_id"] for r in got} == want and len(want) < len(rows)
    kept = spark.createDataFrame(got, docs.schema)

    cleaned = p.boilerplate(spark, kept, sf_dir)
    assert cleaned.columns == columns
    lines = brute_lines([(r["doc_id"], r["text"], r["source"]) for r in got], 10)
    got = cleaned.collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(x[:2] for x in lines)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    cleaned = spark.createDataFrame(got, docs.schema)

    single = p.near_duplicates(spark, cleaned, sf_dir)
    assert single.columns == columns
    groups = brute_groups({r["doc_id"]: r["text"] for r in got}, 5, 80)
    got = single.collect()
    assert {r["doc_id"] for r in got} == {i for i, (_, c) in groups.items() if c == i}
    single = spark.createDataFrame(got, docs.schema)

    safe = p.redaction(spark, single, sf_dir)
    assert safe.columns == columns
    before = {r["doc_id"]: r["text"] for r in got}
    got = safe.collect()
    assert {r["doc_id"] for r in got} == before.keys()
    for r in got:
        if brute_spans(before[r["doc_id"]]):
            assert r["text"] != before[r["doc_id"]] and not brute_spans(r["text"])
        elif r["text"] != before[r["doc_id"]]:  # a span of the randomness tests
            assert "[secret]" in r["text"] and re.search(r"[A-Za-z0-9+/_-]{16,}", before[r["doc_id"]])
        assert r["n_chars"] == len(r["text"])


def test_run_is_the_stages(spark, sf_dir):
    rows = p.run(spark, sf_dir).collect()
    assert [n for n, _ in p.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard", "secret_scans", "packing"]
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for members in by.values():
        assert sum(n for _, n in members) <= packing.SEQUENCE_TOKENS
    docs = table(spark, sf_dir, "documents")
    for _, stage in p.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}


def test_empty_input(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("false")
    for _, stage in p.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
