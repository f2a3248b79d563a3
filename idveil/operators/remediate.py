"""Remediation: rewrite text with identifiers masked, redacted or tokenised.

A narrow projection: no shuffle, no dependence on a scan. By default every occurrence of every value goes that a scan
would find, in any form: the text is normalised and split as in a scan, and what is found there is located in the
text as it stands, across separators, and through a map from normalised to original characters. The historic rule
(``occurrences="first"``) looks at the text as it stands and replaces one occurrence of a value, in its recognised form.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache, partial

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idveil import constants as k
from idveil.functions import recognizers as r
from idveil.functions.columns import as_col, is_ascii, let, strip
from idveil.functions.text import (
    has_shape,
    is_candidate,
    may_hold_identifier,
    normalise_excel_number,
    normalise_unicode,
    split_multi_value,
)
from idveil.functions.tokens import TOKEN_CHARS, tokenize
from idveil.sources.files import may_hold_in_json
from idveil.sources.tables import INERT, text_of

MODES = ("mask", "redact", "tokenize")
OCCURRENCES = ("all", "first")
# In this order of precedence where two identifiers cover the same characters.
_FINDERS = (
    ("AADHAAR", "aadhaar", lambda t, u: r.find_aadhaar(t)),
    ("PAN", "pan", r.find_pan),
    ("GSTIN", "pan", r.find_gstin),
    ("IN_MOBILE", "mobile", lambda t, u: r.find_mobile(t)),
    ("VOTER_ID", "letters7", r.find_voter_id),
    ("PASSPORT", "letters7", r.find_passport),
    ("BANK_ACCOUNT", "account", lambda t, u: r.find_bank_account(t)),
    ("IFSC", "ifsc", r.find_ifsc),
)
_SPAN = "array<struct<start:int,shorter:int,finder:int,nth:int,stop:int,text:string>>"


def _replacement(
    entity: str, match: Column, mode: str, token: str | None, salt: str | None, token_chars: int
) -> Column:
    if token:
        return F.lit(token)
    if mode == "tokenize":
        return tokenize(match["raw_value"], entity, salt, token_chars)
    if mode == "redact":
        return F.lit(f"[REDACTED_{entity}]")
    return match["masked_value"]


def _start_of(value: Column, text: Column, upper: Column) -> Column:
    """Place of the first occurrence, exact or else ignoring case; 0 if there is none."""
    exact = F.position(value, text)
    return F.when(exact > 0, exact).otherwise(F.position(F.upper(value), upper))


def _spans(text: Column, upper: Column, finder: int, replace, entity: str, find) -> Column:
    def span(match: Column, nth: Column) -> Column:
        raw = match["raw_value"]
        if entity == "IN_MOBILE":
            # The prefixed form if the text holds it as such, else the ten digits.
            raw = F.when(_start_of(raw, text, upper) > 0, raw).otherwise(F.substring(raw, -10, 10))
        start = _start_of(raw, text, upper)
        return F.struct(
            start.alias("start"),
            (-F.length(raw)).alias("shorter"),
            F.lit(finder).alias("finder"),
            nth.alias("nth"),
            (start + F.length(raw)).alias("stop"),
            replace(entity, match).alias("text"),
        )

    return F.filter(F.transform(find(text, upper), span), lambda s: s["start"] > 0).cast(_SPAN)


def _rewrite(text: Column, spans: Column) -> Column:
    """Put the replacements in, left to right; a span that overlaps a kept one is skipped."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(done: Column, span: Column) -> Column:
        put = F.struct(
            span["stop"].alias("at"),
            F.concat(
                done["out"],
                F.array(F.substring(text, done["at"], span["start"] - done["at"]), span["text"]),
            ).alias("out"),
        )
        return F.when(span["start"] >= done["at"], put).otherwise(done)

    def finish(done: Column) -> Column:
        return F.concat(F.array_join(done["out"], ""), F.substring(text, done["at"], F.length(text)))

    return F.aggregate(F.array_sort(spans), start, step, finish)


# --- every occurrence ----------------------------------------------------------------------
_VALUE = "array<struct<finder:int,key:string,pattern:string,text:string>>"
_SPACES = rf"[{k.WS}]*+"
_GAP = rf"[{k.WS}\-–—./_|()]*+"
_NUMBER = (rf"(?<!{k.DIGIT})", rf"(?!{k.DIGIT})")
_WORD = (r"(?<![A-Z0-9])", r"(?![A-Z0-9])")
# Between the characters of a value, and around it, wherever it occurs.
_GAPS = {"AADHAAR": _GAP, "IN_MOBILE": _GAP, "PAN": _SPACES}
_EDGES = {
    "AADHAAR": _NUMBER,
    "BANK_ACCOUNT": _NUMBER,
    "IN_MOBILE": (rf"(?<!{k.DIGIT})(?:\+?91|0)?", rf"(?!{k.DIGIT})"),
    "PAN": (k.WORD_START, k.WORD_END),
    "GSTIN": (k.WORD_START, k.WORD_END),
}


def _values(text: Column, finders: list[tuple], replace) -> Column:
    """What a scan finds in a text and its parts: key, pattern of its occurrences, replacement; by precedence."""
    none = F.array().cast(_VALUE)

    def value(i: int, entity: str, match: Column) -> Column:
        raw = match["raw_value"]
        key = F.substring(raw, -10, 10) if entity == "IN_MOBILE" else raw
        before, after = _EDGES.get(entity, _WORD)
        body = F.array_join(F.split(key, ""), _GAPS[entity]) if entity in _GAPS else key
        return F.struct(
            F.lit(i).alias("finder"),
            key.alias("key"),
            F.concat(F.lit(before), body, F.lit(after)).alias("pattern"),
            replace(entity, match).alias("text"),
        )

    def of(forms: Column) -> Column:
        chunk, upper = forms["text"], forms["upper"]
        found = []
        for i, (entity, shape, find) in enumerate(finders):
            values = F.transform(find(chunk, upper), partial(value, i, entity)).cast(_VALUE)
            found.append(F.when(has_shape(chunk, upper, shape), values).otherwise(none))
        return F.concat(none, *found)

    def of_candidate(chunk: Column) -> Column:
        forms = F.struct(chunk.alias("text"), F.upper(chunk).alias("upper"))
        return F.when(is_candidate(chunk), let(forms, of)).otherwise(none)

    chunks = split_multi_value(normalise_excel_number(text))
    return F.sort_array(F.array_distinct(F.flatten(F.transform(chunks, of_candidate))))


def _replacing(values: Column, hit: Column) -> Column:
    """The replacement of an occurrence: that of the first value by precedence that it spells."""
    plain = F.upper(F.regexp_replace(hit, rf"[{k.WS}\-–—./_|()+]+", ""))

    def chosen(spelt: Column) -> Column:
        same = lambda v: (v["key"] == spelt) | (v["key"] == F.substring(spelt, -10, 10))
        return F.get(F.filter(values, same), F.lit(0))["text"]

    return let(plain, chosen)


def _put_in(text: Column, cut: Column, values: Column) -> Column:
    """ASCII text, cut into pieces and the hits between them, with the hits replaced."""
    parts = F.zip_with(
        cut["pieces"], cut["hits"], lambda p, h: F.concat(p, F.coalesce(F.when(h.isNotNull(), _replacing(values, h)), F.lit("")))
    )
    return F.array_join(parts, "")


def _put_back(text: Column, at: Column, cut: Column, values: Column) -> Column:
    """The same for a text whose normalised form was cut; *at* holds the place in the text of each normalised character."""
    start = F.struct(F.lit(0).alias("seen"), F.lit(1).alias("next"), F.array().cast("array<string>").alias("out"))

    def step(done: Column, part: Column) -> Column:
        first = done["seen"] + F.length(part["pieces"])
        last = first + F.length(part["hits"]) - 1
        begin = F.get(at, first)
        put = F.struct(
            (last + 1).alias("seen"),
            (F.get(at, last) + 1).alias("next"),
            F.concat(
                done["out"],
                F.array(F.substring(text, done["next"], begin - done["next"]), _replacing(values, part["hits"])),
            ).alias("out"),
        )
        return F.when(part["hits"].isNotNull(), put).otherwise(done)

    def finish(done: Column) -> Column:
        return F.concat(F.array_join(done["out"], ""), F.substring(text, done["next"], F.length(text)))

    return F.aggregate(F.arrays_zip(cut["pieces"].alias("pieces"), cut["hits"].alias("hits")), start, step, finish)


def _without_any(text: Column, finders: list[tuple], replace) -> Column:
    """The text with every occurrence of every value found in it replaced."""

    def located(form: Column, values: Column, put) -> Column:
        # Of values that begin at one place the longest is taken.
        longest = F.sort_array(F.transform(values, lambda v: F.struct((-F.length(v["key"])).alias("minus"), v["pattern"].alias("pattern"))))
        pattern = F.concat(F.lit("(?iu)"), F.array_join(F.transform(longest, lambda v: v["pattern"]), "|"))

        def cut(p: Column) -> Column:
            return F.struct(
                F.split(form, p, -1).alias("pieces"), F.regexp_extract_all(form, p, F.lit(0)).alias("hits")
            )

        return let(let(pattern, cut), put)

    def plain(form: Column) -> Column:
        found = _values(form, finders, replace)
        return let(
            found,
            lambda v: F.when(F.size(v) == 0, form).otherwise(located(form, v, lambda cut: _put_in(form, cut, v))),
        )

    places = lambda cs: F.flatten(F.transform(cs, lambda c, i: F.array_repeat(i + 1, F.length(c))))

    def mapped(values: Column) -> Column:
        # Normalised character by character, so that each character of the result has a place in the text.
        forms = let(
            F.transform(F.split(text, ""), normalise_unicode),
            lambda cs: F.struct(F.array_join(cs, "").alias("norm"), places(cs).alias("at")),
        )
        return let(
            forms, lambda f: located(f["norm"], values, lambda cut: _put_back(text, f["at"], cut, values))
        )

    def other(norm: Column) -> Column:
        found = F.when(is_candidate(norm), _values(norm, finders, replace)).otherwise(F.array().cast(_VALUE))
        return let(found, lambda v: F.when(F.size(v) == 0, text).otherwise(mapped(v)))

    done = F.when(is_ascii(text), let(text, plain)).otherwise(let(normalise_unicode(text), other))
    return F.when(may_hold_identifier(text), done).otherwise(text)


def sanitize(
    text: Column | str,
    mode: str = "mask",
    salt: str | None = None,
    mask_token: str | None = None,
    entities: Iterable[str] | None = None,
    token_chars: int = TOKEN_CHARS,
    occurrences: str = "all",
) -> Column:
    """Text with the identifiers in it replaced.

    ``mask`` keeps the last characters, ``redact`` names the entity, ``tokenize`` puts
    a keyed token; ``mask_token`` is one fixed text for all. Every occurrence of each value is replaced, spaced
    and separated ones too; a null text stays null. With ``occurrences="first"`` only the first one is, in the form it was
    recognised in.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    if occurrences not in OCCURRENCES:
        raise ValueError(f"occurrences must be one of {OCCURRENCES}, not {occurrences!r}")
    if mode == "tokenize" and not mask_token and not salt:
        raise ValueError("tokens need a secret salt")
    text = as_col(text)
    wanted = None if entities is None else {e.upper() for e in entities}
    finders = [f for f in _FINDERS if wanted is None or f[0] in wanted]
    if not finders:
        return text

    def replace(entity: str, match: Column) -> Column:
        return _replacement(entity, match, mode, mask_token, salt, token_chars)

    if occurrences == "all":
        return _without_any(text, finders, replace)

    def rewritten(forms: Column) -> Column:
        raw, upper = forms["text"], forms["upper"]
        none = F.array().cast(_SPAN)
        spans = F.concat(
            none,
            *[
                F.when(
                    has_shape(raw, upper, shape), _spans(raw, upper, i, replace, entity, find)
                ).otherwise(none)
                for i, (entity, shape, find) in enumerate(finders)
            ],
        )
        return let(spans, lambda s: F.when(F.size(s) == 0, raw).otherwise(_rewrite(raw, s)))

    forms = F.struct(text.alias("text"), F.upper(text).alias("upper"))
    # One pass over the text decides; only candidates are taken apart shape by shape.
    return F.when(is_candidate(text), let(forms, rewritten)).otherwise(text)


@dataclass(frozen=True)
class _How:
    mode: str
    salt: str | None = None
    mask_token: str | None = None
    entities: tuple[str, ...] | None = None
    token_chars: int = TOKEN_CHARS
    occurrences: str = "all"


def _how(mode: str, options: dict) -> _How:
    entities = options.get("entities")
    return _How(**{**options, "mode": mode, "entities": tuple(entities) if entities else None})


@lru_cache(maxsize=64)
def _sanitize_all(session: SparkSession, how: _How) -> Column:
    """The texts of ``_texts``, each sanitised. One expression whatever the number of
    columns; it names one column only, so tables with the same options share it."""

    def clean(text: Column) -> Column:
        done = sanitize(
            text, how.mode, how.salt, how.mask_token, how.entities, how.token_chars, how.occurrences
        )
        return F.when(strip(text) == "", text).otherwise(done)

    return F.transform(F.col("_texts"), clean)


def _before_and_after(df: DataFrame, columns: list[str], how: _How) -> DataFrame:
    """*df* with ``_texts`` and ``_clean``: the columns as text, before and after."""
    types = {f.name: f.dataType for f in df.schema.fields}
    def text(c: str) -> Column:
        if isinstance(types[c], (T.DoubleType, T.FloatType)):
            return F.when(F.isnan(f"`{c}`"), "NaN").otherwise(text_of(c, types[c]))
        return text_of(c, types[c])

    texts = F.array(F.lit(None).cast("string"), *map(text, columns))
    staged = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], texts.alias("_texts"))
    return staged.select("*", _sanitize_all(df.sparkSession, how).alias("_clean"))


def _changes() -> Column:
    """How many of ``_texts`` differ in ``_clean``."""
    return F.size(F.filter(F.zip_with("_texts", "_clean", lambda a, b: ~a.eqNullSafe(b)), lambda x: x))


def remediate(
    df: DataFrame,
    mode: str = "mask",
    columns: list[str] | None = None,
    observation: Observation | None = None,
    count: str | None = None,
    **options,
) -> DataFrame:
    """Every cell of the table sanitised. Columns that may hold an identifier become text, as in a CSV copy.

    Columns of dates, times, flags and short numbers cannot hold one and stay as they are; a NaN stays ``NaN``.

    With an *observation*, the number of changed cells is counted in the same pass and
    can be read from it (``changed_cells``) once the result has been written; a column *count* holds the number per row.
    Further options are those of ``sanitize``.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    wanted = list(columns) if columns is not None else df.columns
    names = [c for c in wanted if not isinstance(types[c], INERT)]
    both = _before_and_after(df, names, _how(mode, options))
    changed = _changes()
    if observation is not None:
        both = both.observe(
            observation, F.coalesce(F.sum(changed), F.lit(0)).cast("bigint").alias("changed_cells")
        )
    at = {c: i for i, c in enumerate(names)}
    return both.select(
        *[F.col("_clean")[at[c] + 1].alias(c) if c in at else F.col(f"`{c}`") for c in df.columns],
        *([] if count is None else [changed.alias(count)]),
    )


def changed_cells(
    df: DataFrame, mode: str = "mask", columns: list[str] | None = None, **options
) -> DataFrame:
    """Per column, how many cells remediation changes: ``column, changed``."""
    names = list(columns) if columns is not None else df.columns
    both = _before_and_after(df.select(*[F.col(f"`{c}`") for c in names]), names, _how(mode, options))
    counts = both.select(
        *[
            F.count_if(~F.col("_texts")[i + 1].eqNullSafe(F.col("_clean")[i + 1])).cast("bigint").alias(c)
            for i, c in enumerate(names)
        ]
    )
    return counts.unpivot([], names, "column", "changed")


def remediate_cells(cells: DataFrame, mode: str = "mask", text: str = "text", **options) -> DataFrame:
    """A tidy table of cells (sheets, document parts) with ``text`` sanitised and ``changed`` set."""
    staged = cells.withColumn("_texts", F.array(F.col(text)))
    out = staged.withColumn("_clean", _sanitize_all(cells.sparkSession, _how(mode, options)))
    changed = ~F.col(text).eqNullSafe(F.col("_clean")[0])
    return out.withColumns({"changed": changed, text: F.col("_clean")[0]}).drop("_texts", "_clean")


def remediate_fields(records: DataFrame, mode: str = "mask", fields: str = "fields", **options) -> DataFrame:
    """Records with an array of texts, each sanitised; ``changed`` is the number of those that differ."""
    staged = records.withColumnRenamed(fields, "_texts")
    out = staged.withColumn("_clean", _sanitize_all(records.sparkSession, _how(mode, options)))
    return out.withColumns({"changed": _changes(), fields: F.col("_clean")}).drop("_texts", "_clean")


# Stand-ins for an escaped backslash and quote, which JSON cannot hold as they are. Strings then end at the next quote.
_BACKSLASH, _QUOTE = "\x01", "\x02"
_JSON_TOKEN = r'("[^"]*+"|-?[0-9][0-9.eE+\-]*+|[^"0-9\-]++|-)'


def _with_escapes(token: Column) -> Column:
    return F.replace(F.replace(token, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))


def _json_value(token: Column) -> Column:
    """A string without quotes and escapes, a number as a scan reads it; null for all between them."""
    text = F.from_json(F.concat(F.lit("["), _with_escapes(token), F.lit("]")), "array<string>")[0]
    power = F.when(token.rlike("[eE]"), token.try_cast("double").cast("decimal(38,0)").cast("string"))
    return F.when(F.startswith(token, F.lit('"')), text).when(token.rlike("^-?[0-9]"), F.coalesce(power, token))


def remediate_json(df: DataFrame, mode: str = "mask", text: str = "text", **options) -> DataFrame:
    """A column of JSON texts, sanitised value by value; ``changed`` tells which texts differ.

    Strings and names are sanitised as they read without escapes, a changed number becomes a string, and all else stays as
    it is written. A text that Spark's parser refuses (no JSON, or a name twice in one object) is sanitised as text.
    """
    none = F.array().cast("array<string>")
    raw = F.col(text)
    marked = F.replace(F.replace(raw, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))
    pieces = F.regexp_extract_all(marked, F.lit(_JSON_TOKEN), F.lit(1))
    plain = ~raw.contains(_BACKSLASH) & ~raw.contains(_QUOTE)
    parses = plain & F.try_parse_json(raw).isNotNull()
    # Only texts that may hold an identifier are parsed and taken apart.
    staged = df.withColumn("_tokens", F.when(may_hold_in_json(raw), F.when(parses, pieces).otherwise(none)))
    values = F.when(F.size("_tokens") == 0, F.array(raw)).otherwise(F.transform("_tokens", _json_value))
    staged = staged.withColumn("_texts", F.coalesce(F.when(F.col("_tokens").isNotNull(), values), none))
    staged = staged.withColumn("_clean", _sanitize_all(df.sparkSession, _how(mode, options)))

    def put(token: Column, i: Column) -> Column:
        before, after = F.get("_texts", i), F.get("_clean", i)
        written = F.to_json(F.array(after))
        return F.when(before.eqNullSafe(after), _with_escapes(token)).otherwise(F.substr(written, F.lit(2), F.length(written) - 2))

    joined = F.array_join(F.transform("_tokens", put), "")
    done = F.when(_changes() == 0, raw).when(F.size("_tokens") == 0, F.col("_clean")[0]).otherwise(joined)
    out = staged.withColumn("_done", done).withColumn("changed", ~raw.eqNullSafe(F.col("_done")))
    return out.withColumn(text, F.col("_done")).drop("_tokens", "_texts", "_clean", "_done")


# A whole text document is one cell.
remediate_documents = remediate_cells


#: A heavy-hitter sketch tracks so many tokens and names so many at most.
SKETCH_ITEMS, SKETCH_TOP = 10_000, 1_000


def _hot_tokens(df: DataFrame, token: str, slot_rows: int, slots: str) -> DataFrame:
    """Tokens that fill more than one slot of rows, and into how many slots they go: SKETCH_TOP rows at most."""
    known = df.select(F.col(f"`{token}`").cast("string").alias("_t")).where("_t IS NOT NULL")
    top = known.agg(F.expr(f"approx_top_k(_t, {SKETCH_TOP}, {SKETCH_ITEMS})").alias("top"))
    found = top.select(F.inline("top")).toDF("_t", "n").where(F.col("n") > slot_rows)
    return found.select("_t", F.ceil(F.col("n") / slot_rows).cast("int").alias(slots))


def correlate(
    left: DataFrame,
    right: DataFrame,
    left_token: str,
    right_token: str | None = None,
    slot_rows: int | None = None,
) -> DataFrame:
    """Join two tokenised tables on their tokens; null tokens meet nothing.

    By default Spark picks the join from the sizes, and adaptive execution cuts skewed partitions. With *slot_rows* the
    join does not rely on that: one sketch per side finds tokens with more rows than that, their rows are
    dealt out to as many slots as they fill, and the other side's rows of these tokens are copied to each slot. All other rows
    have one slot. The sketch decides where rows meet, never whether they do. Copies stay below the rows that the join returns
    for the token, as a slot is only made per *slot_rows* rows.
    """
    right_token = right_token or left_token
    if slot_rows is None:
        return left.join(right, left[left_token] == right[right_token], "inner")
    if slot_rows < 1:
        raise ValueError("slot_rows must be 1 or more")
    hot = _hot_tokens(left, left_token, slot_rows, "_a").join(
        _hot_tokens(right, right_token, slot_rows, "_b"), "_t", "full"
    )
    hot = F.broadcast(hot.select("_t", *[F.coalesce(c, F.lit(1)).alias(c) for c in ("_a", "_b")]))

    def placed(df: DataFrame, token: str, row: str, dealt: str, copied: str) -> DataFrame:
        packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(row), F.col(f"`{token}`").cast("string").alias("_t"))
        sized = packed.where("_t IS NOT NULL").join(hot, "_t", "left").fillna(1, ["_a", "_b"])
        # Seeded, so that a repeated task deals alike; and below the copies, so that all copies of a row share its slot.
        own = sized.withColumn(dealt, F.floor(F.rand(17) * F.col(dealt)).cast("int"))
        return own.select(row, "_t", dealt, F.explode(F.sequence(F.lit(0), F.col(copied) - 1)).alias(copied))

    a = placed(left, left_token, "_left", "_a", "_b")
    b = placed(right, right_token, "_right", "_b", "_a")
    return a.join(b, ["_t", "_a", "_b"]).select("_left.*", "_right.*")


__all__ = [
    "MODES",
    "OCCURRENCES",
    "changed_cells",
    "correlate",
    "remediate",
    "remediate_cells",
    "remediate_documents",
    "remediate_fields",
    "remediate_json",
    "sanitize",
]
