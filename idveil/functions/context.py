"""Context signals: column headers, inline labels, row neighbours, confidence steps."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from idveil import constants as k
from idveil.functions.columns import as_col, is_ascii

CONFIDENCES = ("LOW", "MEDIUM", "HIGH")

# A word boundary that counts letters and digits of every script as word characters
# (vowel signs are not), independent of what \b means in the running Java version.
_W = r"[\p{L}\p{N}_]"
_B = rf"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"


def _java(pattern: str) -> str:
    return "(?iu)" + pattern.replace(r"\b", _B).replace(r"\s", f"[{k.WS}]")


_HEADERS = {e: _java("|".join(ps)) for e, ps in k.HEADER_PATTERNS.items()}
_LABELS = {e: _java(p) for e, p in k.INLINE_LABELS.items()}
_PENALTY = _java(rf"\b(?:{k.PENALTY_WORDS})\b")
# The words start with letters. Those that end in a vowel sign have their boundary only
# in front of a letter.
_OPEN = [w for w in k.NEIGHBOUR_WORDS.split("|") if not w[-1].isalpha()]
_CLOSED = [w for w in k.NEIGHBOUR_WORDS.split("|") if w[-1].isalpha()]
_NEIGHBOURS = (
    rf"(?iu)(?<!{_W})(?:(?:{'|'.join(_CLOSED)})(?!{_W})|(?:{'|'.join(_OPEN)})(?={_W}))"
)
_ASCII_NEIGHBOURS = (
    r"(?i)(?<![A-Za-z0-9_])"
    rf"(?:{'|'.join(w for w in _CLOSED if w.isascii())})(?![A-Za-z0-9_])"
)
# Digits come first and the look behind after them, so other characters fail at once.
_PIN_CODE = rf"[1-9](?<!{_W}[1-9])[0-9]{{5}}(?!{_W})"
_MOBILE = rf"[6-9](?<!{_W}[6-9]){k.DIGIT}{{9}}(?!{_W})"
# The local part is taken once and whole (possessive), so long dotted runs stay linear.
# The two look-aheads only ask that it holds a word boundary.
_LOCAL = r"A-Za-z0-9._%+\-"
_EMAIL = (
    rf"(?<![{_LOCAL}])"
    rf"(?:(?<={_W})(?![A-Za-z0-9_]+@)|(?<!{_W})(?=[.%+\-]*[A-Za-z0-9_]))"
    rf"[{_LOCAL}]++@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}+(?!{_W})"
)


def entity_of_header(name: str) -> str | None:
    """``column_entity`` for a name known while planning, decided on the driver."""
    words = name.translate(str.maketrans("_-.", "   "))
    for entity, patterns in k.HEADER_PATTERNS.items():
        if any(re.search(p, words, re.IGNORECASE) for p in patterns):
            return entity
    return None


def header_is_penalised(name: str) -> bool:
    """``is_penalised`` for a name known while planning."""
    words = name.translate(str.maketrans("_-", "  "))
    return re.search(rf"\b(?:{k.PENALTY_WORDS})\b", words, re.IGNORECASE) is not None


def column_entity(name: Column | str) -> Column:
    """Entity a column header stands for (first in the fixed order), or null."""
    words = F.translate(as_col(name), "_-.", "   ")
    return F.coalesce(*[F.when(words.rlike(p), F.lit(e)) for e, p in _HEADERS.items()])


def is_penalised(name: Column | str) -> Column:
    """Headers such as invoice or serial number, which lower every finding."""
    words = F.translate(as_col(name), "_-", "  ")
    return F.coalesce(words.rlike(_PENALTY), F.lit(False))


def has_label(text: Column | str, entity: str) -> Column:
    if entity not in _LABELS:
        return F.lit(False)
    return as_col(text).rlike(_LABELS[entity])


def inline_labels(text: Column | str) -> Column:
    """Entities whose label occurs in the text, sorted."""
    return F.array_compact(
        F.array(*[F.when(has_label(text, e), F.lit(e)) for e in sorted(_LABELS)])
    )


def row_is_dense(context: Column | str) -> Column:
    """A postal code, mobile, e-mail address or personal-data word in the row."""
    context = as_col(context)
    word = F.when(is_ascii(context), context.rlike(_ASCII_NEIGHBOURS)).otherwise(
        context.rlike(_NEIGHBOURS)
    )
    mail = context.contains("@") & context.rlike(_EMAIL)
    return F.coalesce(
        context.rlike(_PIN_CODE) | context.rlike(_MOBILE) | word | mail, F.lit(False)
    )


def confidence_rank(confidence: Column | str) -> Column:
    """LOW 0, MEDIUM 1, HIGH 2; anything else 0."""
    confidence = as_col(confidence)
    return F.when(confidence == "HIGH", 2).when(confidence == "MEDIUM", 1).otherwise(0)


def step_confidence(confidence: Column, supported: Column, penalised: Column) -> Column:
    """LOW under a penalty; otherwise one step up where the context supports the entity."""
    known = F.when(confidence.isin(*CONFIDENCES), confidence).otherwise(F.lit("LOW"))
    return (
        F.when(penalised, F.lit("LOW"))
        .when(supported & confidence.isin("HIGH", "MEDIUM"), F.lit("HIGH"))
        .when(supported, F.lit("MEDIUM"))
        .otherwise(known)
    )


def boost_confidence(
    confidence: Column | str,
    entity: Column | str,
    column_entity_: Column | None,
    labels: Column,
    column_name: Column | None = None,
    dense_row: Column | None = None,
) -> Column:
    """The rule above for free-standing columns; *labels* is an array of entities."""
    entity = as_col(entity)
    supported = F.array_contains(labels, entity)
    if column_entity_ is not None:
        supported = supported | F.coalesce(column_entity_ == entity, F.lit(False))
    if dense_row is not None:
        supported = supported | dense_row
    penalised = F.lit(False) if column_name is None else is_penalised(column_name)
    return step_confidence(as_col(confidence), supported, penalised)
