"""Sanitised copies of file trees: what a scan of a path finds is not in the copy.

Each input file becomes a folder ``source_file=<path below the root>`` with a folder ``source_block=<first byte>`` for each of
its splits. Read in the order of their names, they give the records of the file in order, header records included. A split
is rewritten where it is read: nothing is shuffled but delimited records that cross two splits.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from idveil.constants import TEXT_SUFFIXES
from idveil.operators.remediate import remediate, remediate_cells, remediate_fields, remediate_json
from idveil.sources import files as f
from idveil.sources.parquet_files import parquet_frames

SOURCE, BLOCK, PLACE = "source_file", "source_block", "source_row"
FORMATS = ("csv", "tsv", "text", "jsonl", "json", "parquet")
_SEPARATORS = {"csv": ",", "tsv": "\t"}


@dataclass(frozen=True)
class PathCopies:
    """Per format, how many cells were changed (text: lines; JSON: records), and the files that could not be read."""

    changed: dict[str, int] = field(default_factory=dict)
    unreadable: list[str] = field(default_factory=list)


def _below(file: Column, root: str) -> Column:
    """The path of a file below the root; of a root that is a file itself, its name. Never null."""
    plain, root = f.plain_path(file), f.plain_text(root).rstrip("/")
    inside = F.when(F.startswith(plain, F.lit(root + "/")), F.substr(plain, F.lit(len(root) + 2)))
    return F.coalesce(inside, F.regexp_extract(plain, "[^/]+$", 0), F.lit(""))


def _placed(file: Column, block: Column, row: Column, root: str) -> list[Column]:
    # Zeros in front, so that names sort as numbers do.
    start = F.lpad(F.coalesce(block, F.lit(0)).cast("string"), 20, "0")
    return [_below(file, root).alias(SOURCE), F.coalesce(start, F.lit("")).alias(BLOCK), row.alias(PLACE)]


def delimited_line(fields: Column, separator: str) -> Column:
    """One record as text, with quotes where a field needs them."""
    unsafe = f'[{separator}"\r\n]'
    quoted = F.transform(
        fields,
        lambda v: F.when(v.rlike(unsafe), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v),
    )
    # A record of one empty field is no empty line.
    return F.when((F.size(fields) == 1) & (F.get(fields, F.lit(0)) == ""), F.lit('""')).otherwise(F.array_join(quoted, separator))


def copied_records(spark: SparkSession, path: str, name: str, mode: str = "mask", splits: int | None = None, **options) -> DataFrame:
    """Records of the files of one format other than Parquet, sanitised.

    Columns: ``source_file, source_block, source_row`` (order within the block), ``value`` (the record as text) and
    ``changed`` (number of cells). Delimited records are sanitised field by field, the header too, and lose no field; empty
    lines between them are no records. Text goes line by line, as it is scanned. JSON stays JSON: strings and names are
    sanitised as they read without escapes, and a number that is changed becomes a string; what does not parse goes as text.
    """
    if name in _SEPARATORS:
        records = f.delimited_files(spark, path, name, _SEPARATORS[name], splits)
        done = remediate_fields(records, mode, "fields", **options)
        value = delimited_line(F.col("fields"), _SEPARATORS[name])
        return done.select(*_placed(F.col("_file"), F.col("_block"), F.col("_row"), path), value.alias("value"), "changed")
    lines = f.lines_of(spark, path, *(TEXT_SUFFIXES if name == "text" else (name,)), whole=name == "json")
    lines = lines.select(*_placed(F.col("_file"), F.col("_block"), F.col("_id"), path), "value")
    rewrite = remediate_cells if name == "text" else remediate_json
    return rewrite(lines, mode, "value", **options).withColumn("changed", F.col("changed").cast("int"))


def _write(copy: DataFrame, changed: Column, out: str, text: bool) -> int:
    seen = Observation()
    # In order within each task, so that the writer has no reason to sort again.
    ordered = copy.observe(seen, F.coalesce(F.sum(changed), F.lit(0)).cast("bigint").alias("changed")).sortWithinPartitions(SOURCE, BLOCK, PLACE)
    if text:
        ordered.select(SOURCE, BLOCK, "value").write.partitionBy(SOURCE, BLOCK).text(out)
    else:
        ordered.drop(PLACE, "_changed").write.partitionBy(SOURCE, BLOCK).parquet(out)
    return int(seen.get["changed"])


def remediate_path(
    spark: SparkSession, path: str, out: str, mode: str = "mask", only: tuple[str, ...] | None = None, **options
) -> PathCopies:
    """Write a sanitised copy of every supported file under *path* to ``out/<format>``; ``options`` as for ``sanitize``.

    *out* must not lie within *path* and must hold no copies of these formats yet. Parquet files keep their columns, apart by schema in
    ``out/parquet/<number>``; columns named as the folders are refused. Files that cannot be read have no copy and are named.
    """
    if f"{f.plain_text(out).rstrip('/')}/".startswith(f"{f.plain_text(path).rstrip('/')}/"):
        raise ValueError("the copy must not lie within the path it is made of")
    found = f.list_path(spark, path)
    changed: dict[str, int] = {}
    unreadable: list[str] = []
    for name in FORMATS:
        suffixes = TEXT_SUFFIXES if name == "text" else (name,)
        if not found.has(*suffixes) or (only is not None and name not in only):
            continue
        if name != "parquet":
            copy = copied_records(spark, path, name, mode, found.bound(*suffixes), **options)
            changed[name] = _write(copy, F.col("changed"), f"{out}/{name}", True)
            continue
        frames, failed = parquet_frames(spark, path)
        clash = {c for df in frames for c in df.columns} & {SOURCE, BLOCK, PLACE, "_changed"}
        if clash:
            raise ValueError(f"columns named as the folders of a copy: {sorted(clash)}")
        changed[name] = 0
        for i, df in enumerate(frames):
            meta = F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.col("_metadata.row_index")
            placed = df.select("*", *_placed(*meta, path))
            done = remediate(placed, mode, df.columns, count="_changed", **options)
            changed[name] += _write(done, F.col("_changed"), f"{out}/parquet/{i}", False)
        if failed is not None:
            unreadable += [r["path"] for r in failed.select("path").collect()]
    return PathCopies(changed, sorted(unreadable))


__all__ = ["BLOCK", "FORMATS", "PLACE", "SOURCE", "PathCopies", "copied_records", "delimited_line", "remediate_path"]
