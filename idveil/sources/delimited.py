"""Records of delimited files, exactly as a record reader sees them, from files that may be split.

Whether a line begins a record depends on the quotes before it, so a split cannot be read alone. A first pass
follows each split from both states (outside and inside quotes) and notes where it ends and how many records it begins;
composing these small lines per file gives each split its true state and its first record number. The second
pass then cuts records split by split. Only records that cross a split are brought together. No line is moved, no file
is read by one task, and a record has as many fields as it has.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idveil.sources.numbering import MAX_BROADCAST_SPLITS


def ends_inside(line: str, separator: str, inside: bool) -> bool:
    """Whether a quoted field is open after the line. Quotes open a field only at its start."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == '"':
                at += 2
                continue
            inside, at = False, at + 1
        elif line[at : at + 1] == '"':
            inside, at = True, at + 1
            continue
        at = line.find(separator, at)
        if at < 0:
            return False
        at += 1


def fields_of(record: str, separator: str) -> list[str]:
    """The fields of one record; line breaks in quotes belong to them."""
    csv.field_size_limit(2**31 - 1)
    rows = list(csv.reader(record.split("\n") if '"' not in record else record.splitlines(keepends=True), delimiter=separator))
    return [x for r in rows for x in r]


def _scans(frames: Iterator[pd.DataFrame], separator: str, blank_counts: bool) -> Iterator[pd.DataFrame]:
    """Per split: for each state at its start, the state at its end and the records begun; its first record."""
    now, ends, counts, first, open_head = None, [], [], None, None

    def done() -> list:
        head = None if first is None or open_head else first
        return [(*now, ends[0], ends[1], counts[0], counts[1], head)]

    columns = ["_file", "_block", "end0", "end1", "n0", "n1", "head"]
    for f in frames:
        out = []
        for file, block, line in zip(f["_file"], f["_block"], f["value"]):
            if (file, block) != now:
                if now is not None:
                    out += done()
                now, ends, counts, first, open_head = (file, block), [False, True], [0, 0], None, False
            for s in (0, 1):
                counts[s] += not ends[s] and (blank_counts or line != "")
            if open_head:
                first += "\n" + line
            elif first is None and not ends[0] and line:
                first, open_head = line, True
            ends = [ends_inside(line, separator, e) for e in ends]
            open_head = open_head and ends[0]
        if out:
            yield pd.DataFrame(out, columns=columns)
    if now is not None:
        yield pd.DataFrame(done(), columns=columns)


def _records(frames: Iterator[pd.DataFrame], separator: str, blank_counts: bool) -> Iterator[pd.DataFrame]:
    """Records of a split: file, number, fields; those that cross its edges as parts instead."""
    columns = ["_file", "_row", "fields", "part", "_block"]
    now, inside, number, lines, begun_here = None, False, 0, [], True

    def closed(crosses: bool) -> tuple:
        text = "\n".join(lines)
        if crosses or not begun_here:
            return (now[0], number, None, text, now[1])
        return (now[0], number, fields_of(text, separator), None, now[1])

    for f in frames:
        out = []
        for file, block, line, state, before in zip(f["_file"], f["_block"], f["value"], f["inside"], f["before"]):
            if (file, block) != now:
                if lines:
                    out.append(closed(True))
                now, inside, number, lines, begun_here = (file, block), bool(state), int(before), [], not state
            if not inside and not lines:
                begun_here = True
                number += blank_counts or line != ""
                if line == "":
                    continue
            lines.append(line)
            inside = ends_inside(line, separator, inside)
            if not inside:
                out.append(closed(False))
                lines = []
        if out:
            yield pd.DataFrame(out, columns=columns)
    if lines:
        yield pd.DataFrame([closed(True)], columns=columns)


def delimited_records(
    lines: DataFrame, separator: str, blank_counts: bool, splits: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Records (_file, _block, _row, fields; the block is where a record begins) and heads (_file, head, _head_row) of tagged lines.

    Records are numbered from 1 per file; empty lines are no records, and count only with *blank_counts*. The head is
    the first record that is not empty. A quoted field that is never closed ends with its file.
    """
    lines = lines.select("_file", "_block", "_id", "value")
    scan = "_file string, _block long, end0 boolean, end1 boolean, n0 long, n1 long, head string"
    scanned = lines.select("_file", "_block", "value").mapInPandas(
        lambda frames: _scans(frames, separator, blank_counts), scan
    )
    # One line per split of a file, composed in order.
    per_file = scanned.groupBy("_file").agg(
        F.sort_array(F.collect_list(F.struct("_block", "end0", "end1", "n0", "n1", "head"))).alias("all")
    )
    placed = "array<struct<_block:bigint,inside:boolean,before:bigint,head:string>>"
    start = F.struct(
        F.lit(False).alias("inside"), F.lit(0).cast("long").alias("before"), F.array().cast(placed).alias("out")
    )

    def step(s, x):
        here = F.struct(
            x["_block"].alias("_block"), s["inside"].alias("inside"), s["before"].alias("before"),
            F.when(~s["inside"], x["head"]).alias("head"),
        )
        return F.struct(
            F.when(s["inside"], x["end1"]).otherwise(x["end0"]).alias("inside"),
            (s["before"] + F.when(s["inside"], x["n1"]).otherwise(x["n0"])).alias("before"),
            F.concat(s["out"], F.array(here)).alias("out"),
        )

    composed = per_file.select("_file", F.aggregate("all", start, step, lambda s: s["out"]).alias("all"))
    offsets = composed.select("_file", F.inline("all")).drop("head")
    bounded = splits is not None and splits <= MAX_BROADCAST_SPLITS  # three numbers and a path for each
    joined = lines.join(F.broadcast(offsets) if bounded else offsets, ["_file", "_block"])
    if not bounded:
        joined = joined.sortWithinPartitions("_file", "_block", "_id")
    record = "_file string, _row long, fields array<string>, part string, _block long"
    cut = joined.select("_file", "_block", "value", "inside", "before").mapInPandas(
        lambda frames: _records(frames, separator, blank_counts), record
    )
    whole = cut.where("fields IS NOT NULL").select("_file", "_block", "_row", "fields")
    crossing = (
        cut.where("part IS NOT NULL")
        .groupBy("_file", "_row")
        .agg(F.sort_array(F.collect_list(F.struct("_block", "part"))).alias("parts"))
        .select("_file", F.col("parts")[0]["_block"].alias("_block"), "_row", F.array_join("parts.part", "\n").alias("text"))
    )

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[["_file", "_block", "_row"]].assign(fields=[fields_of(t, separator) for t in f["text"]])

    crossing = crossing.mapInPandas(parsed, "_file string, _block long, _row long, fields array<string>")
    heads = composed.select("_file", F.filter("all", lambda x: x["head"].isNotNull())[0]["head"].alias("text"))

    def named(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[["_file"]].assign(head=[fields_of(t, separator) for t in f["text"]])

    heads = heads.where("text IS NOT NULL").mapInPandas(named, "_file string, head array<string>")
    return whole.unionByName(crossing), heads
