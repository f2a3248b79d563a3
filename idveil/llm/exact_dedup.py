"""Exact dedup: groups of equal texts by 128-bit content hash, with the bytes compared inside each group.

Two shuffles: the distinct texts of each task under their hash (equal texts of a task collapse before it, so a
text that a third of all rows hold sends one row per task), then ids with 48 bytes of digests. The second
join meets one row per group, so a hot group is only ever on its many-rows side, which AQE may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idveil.llm.common import SPACES, pair, table


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after replacing each run of ASCII white space by one space. The smallest id of
    equal texts stays. A null text is an empty one. A null id never is the smallest unless all ids of the group
    are null; it is then kept. Rows that repeat an id are the same document: they count in group_size, and all
    of them are kept if the id is the smallest. An empty table gives an empty result; other columns are ignored.
    """
    normal = F.regexp_replace("text", SPACES, " ")
    rows = pair(docs, id_col, text_col).select("doc_id", normal.alias("text"))
    rows = rows.select(
        "doc_id", "text", F.unhex(F.md5("text")).alias("hash"), F.unhex(F.sha2("text", 256)).alias("digest")
    )
    # The text itself is a grouping key: two texts under one hash stay two groups.
    groups = (
        rows.groupBy("hash", "digest", "text")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .drop("text")
    )
    joined = rows.drop("text").join(groups, ["hash", "digest"], "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they were, whose id stays."""
    stay = exact_groups(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("__stays")).distinct()
    return docs.join(stay, docs[id_col].eqNullSafe(stay["__stays"]), "left_semi")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY ALL)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)
"""
