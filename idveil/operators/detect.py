"""Detection: rows of cells to one line per match, without a shuffle.

Each stage looks at less data than the one before: cells that cannot hold an
identifier fall away inside the row, rows without such cells produce nothing, and
only what is left is normalised, split into chunks and read by the recognizers.
All recognizers read a chunk in one pass; their matches are concatenated and
exploded once.

The explodes are the "outer" ones with a filter behind them. A plain explode makes the
optimizer infer ``size(array) > 0`` and push that filter down, which would compute the
whole array (here: all recognition work) a second time in front of it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idveil.functions import recognizers as r
from idveil.functions.context import (
    column_entity,
    has_label,
    is_penalised,
    row_is_dense,
    step_confidence,
)
from idveil.functions.registry import Chunk, Recognizer
from idveil.functions.text import (
    has_shape,
    is_candidate,
    may_hold_identifier,
    normalise_text,
    split_multi_value,
)
from idveil.sources.tables import row_context as joined_cells

READ_ERROR = "FILE_READ_ERROR"
LOCATION = ("file", "sheet", "sheet_ord", "row")
_SLIM = "array<struct<entity_type:string,raw_value:string,masked_value:string,confidence:string>>"


@dataclass(frozen=True)
class Settings:
    """What to detect and which context counts."""

    recognizers: tuple[Recognizer, ...]
    use_row_context: bool = True
    use_penalty: bool = True
    masked: bool = True
    keep_clear_pans_as_masked: bool = False
    keep: tuple[str, ...] = ()  # columns to carry along

    @property
    def gated(self) -> bool:
        """The candidate tests hold for the built-in recognizers only."""
        return all(x.built_in for x in self.recognizers)

    @property
    def tested(self) -> bool:
        """Every recognizer says what a text must show."""
        return all(x.built_in or x.test for x in self.recognizers)

    def or_own(self, built_in: Column, text: Column, raw: bool = False) -> Column:
        """The candidate test of all recognizers. Raw text that is not plain ASCII may still become a candidate."""
        for x in self.recognizers:
            if x.test is not None:
                own = F.coalesce(x.test(text), F.lit(False))
                built_in = built_in | (own | text.rlike(r"[^\x00-\x7F]") if raw else own)
        return built_in


@dataclass(frozen=True)
class Step:
    """A projection, or else a filter."""

    columns: tuple[Column | str, ...] = ()
    condition: Column | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        return df.select(*self.columns) if self.condition is None else df.where(self.condition)


def _select(*columns: Column | str) -> Step:
    return Step(columns=columns)


def _where(condition: Column) -> Step:
    return Step(condition=condition)


def _slim(matches: Column) -> Column:
    """Matches without the fields a finding does not report."""
    return F.transform(
        matches,
        lambda m: F.struct(
            m["entity_type"].alias("entity_type"),
            m["raw_value"].alias("raw_value"),
            m["masked_value"].alias("masked_value"),
            m["confidence"].alias("confidence"),
        ),
    )


def _error(message: str) -> Column:
    """A read error in the shape of a match."""
    return F.struct(
        F.lit(READ_ERROR).alias("entity_type"),
        F.col(message).alias("raw_value"),
        F.col(message).alias("masked_value"),
        F.lit("LOW").alias("confidence"),
    )


def _chunk_steps(s: Settings, own_context: bool) -> list[Step]:
    """Candidate cells, normalised and split: one line per chunk."""
    place = (*LOCATION, *s.keep)
    cells = F.col("cells")
    if s.tested:
        cells = F.filter(
            cells,
            lambda c: c["error"] | s.or_own(~c["inert"] & may_hold_identifier(c["text"]), c["text"], raw=True),
        )
    context = F.col("row_context") if own_context else joined_cells()
    dense = row_is_dense("context") if s.use_row_context else F.lit(False)
    here = (*place, "dense", "ord", "column", "column_entity", "penalised", "error")
    chunks = split_multi_value("clean")
    steps = [
        _select(*place, cells.alias("hits"), "row_context" if own_context else "cells"),
        # Only rows with a candidate have their neighbours joined and tested, once per row.
        _select(*place, "hits", F.when(F.size("hits") > 0, context).alias("context")),
        _select(
            *place,
            "hits",
            F.when(F.col("context").isNotNull(), dense).otherwise(F.lit(False)).alias("dense"),
        ),
        _select(*place, "dense", F.inline_outer("hits")),
        _where(F.col("text").isNotNull()),
        _select(
            *place,
            "dense",
            "ord",
            "column",
            F.when(F.col("penalised").isNull(), column_entity("column"))
            .otherwise(F.col("column_entity"))
            .alias("column_entity"),
            F.coalesce(F.col("penalised"), is_penalised("column")).alias("penalised"),
            "error",
            normalise_text("text").alias("clean"),
        ),
    ]
    if s.tested:
        steps.append(_where(F.col("error") | s.or_own(is_candidate("clean"), F.col("clean"))))
    steps.append(_select(*here, F.posexplode_outer(chunks).alias("chunk_no", "chunk")))
    if s.tested:
        steps.append(_where(F.col("error") | s.or_own(is_candidate("chunk"), F.col("chunk"))))
    return steps


def _match_steps(s: Settings) -> list[Step]:
    """Chunks to matches: one line per match."""
    place = (*LOCATION, *s.keep)
    here = (*place, "dense", "ord", "column", "column_entity", "penalised", "error", "chunk_no")
    nothing = F.array().cast(_SLIM)

    # Which shapes a chunk shows decides which recognizers read it, and which of the
    # forms they share are built at all.
    wanted = {x.shape for x in s.recognizers if x.shape}
    wanted |= {"masked", "pan"} if s.masked else set()
    shapes = sorted(wanted)
    shown = [has_shape(F.col("chunk"), F.col("upper"), x).alias(f"is_{x}") for x in shapes]

    def form(shape: str, value: Column) -> Column:
        return F.when(F.col(f"is_{shape}"), value) if shape in wanted else F.lit(None)

    digits = r.strip_phone_prefixes(r.strip_aadhaar_separators("chunk"))
    steps = [
        _select(*here, "chunk", F.upper("chunk").alias("upper")),
        _select("*", *shown),
        _select(
            "*",
            form("aadhaar", digits).cast("string").alias("aadhaar_digits"),
            form("mobile", r.strip_mobile_separators("chunk")).cast("string").alias("mobile_digits"),
        ),
    ]

    chunk = Chunk(*(F.col(c) for c in ("chunk", "upper", "aadhaar_digits", "mobile_digits")))

    def read(x: Recognizer) -> Column:
        found = _slim(x.find(chunk))
        if x.test is not None:
            return F.when(x.test(F.col("chunk")), F.coalesce(found, nothing)).otherwise(nothing)
        if x.shape is None:
            return F.coalesce(found, nothing)
        return F.when(F.col(f"is_{x.shape}"), found).otherwise(nothing)

    arrays = [F.col(f"m_{x.entity}") for x in s.recognizers]
    steps.append(
        _select(
            *here,
            "chunk",
            "upper",
            *[f"is_{x}" for x in shapes],
            *[read(x).alias(f"m_{x.entity}") for x in s.recognizers],
        )
    )
    if s.masked:
        pans = any(x.entity == "PAN" and x.built_in for x in s.recognizers)
        clear = F.col("m_PAN")["raw_value"] if pans and not s.keep_clear_pans_as_masked else None
        hidden = _slim(r.find_masked("chunk", F.col("upper"), clear))
        arrays.append(
            F.when(F.col("is_masked") | F.col("is_pan"), hidden).otherwise(nothing)
        )
    arrays.append(F.when(F.col("error"), F.array(_error("chunk"))).otherwise(nothing))

    # The label of an entity is looked for only where that entity was found, once per chunk.
    def supported(entity: str) -> Column:
        support = (
            F.col("dense")
            | F.coalesce(F.col("column_entity") == entity, F.lit(False))
            | has_label("chunk", entity)
        )
        return F.when(F.size(f"m_{entity}") > 0, support).otherwise(F.lit(False))

    steps += [
        _select(
            *[c for c in here if c not in ("dense", "column_entity", "error")],
            *[supported(x.entity).alias(f"s_{x.entity}") for x in s.recognizers],
            F.concat(nothing, *arrays).alias("matches"),
        ),
        _select(
            *[c for c in here if c not in ("dense", "column_entity", "error")],
            *[f"s_{x.entity}" for x in s.recognizers],
            F.posexplode_outer("matches").alias("match_no", "m"),
        ),
        _where(F.col("match_no").isNotNull()),
    ]

    base = F.col("m.confidence")
    raised = F.lit(False)
    for x in s.recognizers:
        raised = F.when(F.col("m.entity_type") == x.entity, F.col(f"s_{x.entity}")).otherwise(raised)
    graded = step_confidence(base, raised, F.col("penalised") if s.use_penalty else F.lit(False))
    is_real = F.col("m.entity_type").isin(*[x.entity for x in s.recognizers])
    steps.append(
        _select(
            *place,
            "column",
            "ord",
            "chunk_no",
            "match_no",
            F.col("m.entity_type").alias("entity_type"),
            F.col("m.masked_value").alias("masked_value"),
            F.when(is_real, graded).otherwise(base).alias("confidence"),
            F.unhex(F.sha2(F.col("m.raw_value"), 256)).alias("value_key"),
        )
    )
    return steps


@lru_cache(maxsize=64)
def _plan(session: SparkSession, settings: Settings, own_context: bool) -> tuple[Step, ...]:
    """The steps name columns only, so scans with the same settings share them."""
    return (*_chunk_steps(settings, own_context), *_match_steps(settings))


def detect(rows: DataFrame, settings: Settings) -> DataFrame:
    """One line per match: location, entity, masked value, confidence, hashed value.

    The clear value leaves this stage only as a SHA-256 digest, so that it reaches no
    shuffle or spill file.
    """
    found = rows
    for step in _plan(rows.sparkSession, settings, "row_context" in rows.columns):
        found = step.apply(found)
    return found
