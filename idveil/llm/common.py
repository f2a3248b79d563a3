"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space separates words; other white space belongs to them.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pair(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), under names of our own, so that other columns cannot clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def words(text: Column) -> Column:
    """The words of a text as an array; no words, empty array."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once per row however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def written(df: DataFrame) -> DataFrame:
    """df as a table in the folder that spark.checkpoint.dir names: computed once, cut from its lineage, and safe from
    lost executors. The folder's owner clears it, as with checkpoints. Where the setting is unset, a local session makes a
    folder of its own; a cluster, whose executors would not see that, is refused."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="idveil-"))
        folder = spark.sparkContext.getCheckpointDir()
    path = f"{folder.rstrip('/')}/idveil-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus."""
    return F.crc32(id_col.cast("string").cast("binary")) % modulus
