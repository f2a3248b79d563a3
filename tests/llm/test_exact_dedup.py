import hashlib
import re

from idveil.llm.exact_dedup import drop_copies, exact_groups


def test_against_brute_force(spark, awkward):
    rows = [(r["doc_id"], re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")) for r in awkward.collect()]
    want = []
    for doc_id, text in rows:
        same = [i for i, t in rows if t == text]
        keep = min((i for i in same if i is not None), default=None)
        want.append((doc_id, keep, len(same), doc_id == keep, hashlib.sha256(text.encode()).hexdigest()))
    got = [tuple(r) for r in exact_groups(awkward).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_hash_collisions_stay_apart(spark):
    """Equal hash, other bytes: the grouping key holds the text itself."""
    plan = exact_groups(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert "keys=[hash" in plan._jdf.queryExecution().executedPlan().toString()
    assert "text" in plan._jdf.queryExecution().optimizedPlan().toString()


def test_drop_copies_keeps_columns_and_empty(awkward, empty):
    kept = drop_copies(awkward)
    assert kept.columns == awkward.columns
    ids = [r["doc_id"] for r in kept.collect()]
    # 1, 2 and 3 differ: null and "" are the empty text, white space is one space.
    assert sorted(ids, key=str) == sorted([1, 3, 4, 5, None, 7, 8, 9, 10], key=str)
    assert exact_groups(empty).count() == 0
