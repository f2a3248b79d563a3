"""Text normalisation as Column expressions (Unicode, spreadsheet floats, multi-value cells)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from idveil import constants as k
from idveil.functions.columns import as_col, is_ascii, let, strip


def nfkc(text: Column | str) -> Column:
    """Unicode compatibility normalisation inside the JVM.

    Spark ships ICU4J; ``reflect`` calls its static ``compose(text, compat)``,
    so no row is sent to a Python worker.
    """
    return F.reflect(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), as_col(text), F.lit(True)
    )


def translate_indic_digits(text: Column | str) -> Column:
    return F.translate(as_col(text), k.INDIC_DIGITS, "0123456789" * 5)


def strip_zero_width(text: Column | str) -> Column:
    return F.regexp_replace(as_col(text), k.ZERO_WIDTH, "")


def plain_spaces(text: Column | str) -> Column:
    return F.regexp_replace(as_col(text), k.UNUSUAL_SPACES, " ")


def straight_quotes(text: Column | str) -> Column:
    return F.translate(as_col(text), k.CURLY_QUOTES, k.STRAIGHT_QUOTES)


def normalise_unicode(text: Column | str) -> Column:
    """NFKC, regional digits, invisible characters, odd spaces, curly quotes.

    Pure ASCII text is already in that form and takes the short way.
    """
    text = as_col(text)
    full = straight_quotes(plain_spaces(strip_zero_width(translate_indic_digits(nfkc(text)))))
    return F.when(is_ascii(text), text).otherwise(full)


def normalise_excel_number(text: Column | str) -> Column:
    """``9876543210.0`` becomes ``9876543210``; ``123.45`` and ``1.0.0`` stay."""
    text = as_col(text)
    pattern = rf"(?<![{k.DIGIT}.])({k.DIGIT}++)\.0(?![{k.DIGIT}.])"
    return F.when(text.contains(".0"), F.regexp_replace(text, pattern, "$1")).otherwise(text)


def split_multi_value(text: Column | str) -> Column:
    """The whole text, followed by its parts of five or more characters if it splits."""
    text = as_col(text)
    lone_slash = rf"(?<!{k.DIGIT})/(?!{k.DIGIT})"
    pieces = F.flatten(
        F.transform(F.split(text, r"[,;|\\]+"), lambda p: F.split(p, lone_slash))
    )
    parts = F.filter(
        F.transform(pieces, strip), lambda p: F.length(p) >= k.MIN_PART_CHARS
    )
    return F.when(
        text.rlike(rf"[,;|\\]|{lone_slash}"), F.concat(F.array(text), parts)
    ).otherwise(F.array(text))


def normalise_cell(text: Column | str) -> Column:
    """All steps above: cell text to the array of chunks the recognizers read."""
    return split_multi_value(normalise_text(text))


def normalise_text(text: Column | str) -> Column:
    """Unicode forms and spreadsheet floats: what is left before splitting."""
    return let(normalise_unicode(text), normalise_excel_number)


# Characters outside ASCII that can become a digit: numbers in any script, and the
# squared-date and squared-unit blocks whose compatibility form holds digits.
_MAY_BECOME_DIGIT = r"[\p{N}\u32c0-\u32cb\u3358-\u33fe]"

# Every identifier, plain or masked, holds digits. Each test therefore starts at a digit
# and looks back for letters, so text without digits costs one comparison a character.
def _shapes(d: str, a: str, s: str) -> dict[str, str]:
    """Necessary shapes for digits *d*, letters *a*, spaces *s* (bodies of character classes)."""
    gap = rf"[{s}\-–—./_|()]*+"
    return {
        "mobile": rf"[6-9](?:{gap}[{d}]){{9}}",
        "aadhaar": rf"[2-9](?:{gap}[{d}]){{11}}",
        "account": rf"(?!0)[{d}]{{9}}",
        "letters7": rf"(?=[{d}])(?<=[{a}])[{d}]{{7}}",
        "ifsc": rf"0(?<=[{a}]{{4}}0)[{a}0-9]{{6}}",
        "pan": (
            rf"[{d}]{{4}}[{s}]*+[{a}*]"
            rf"(?:(?<=[{a}][{s}]{{0,3}}[{d}]{{4}}[{s}]{{0,3}}[{a}])(?![\p{{L}}\p{{N}}_])"
            rf"|(?<=[{a}*]{{5}}[{d}]{{4}}[{a}*])"
            rf"|(?<=[{s}]{{4}}[{d}]{{4}}[{s}]{{0,3}}[{a}])|(?<=[{s}]{{4}}[{a}]))"
        ),
        "masked": (
            rf"[{d}]{{3}}(?:(?<=[Xx*]{{4}}[{s}\-]{{0,3}}[{d}]{{3}}|[{s}\-]{{4}}[{d}]{{3}})"
            rf"|[{d}]?[{s}\-]*+[Xx*]{{4}})"
        ),
    }


_ASCII_SPACE = r"\s\x1c-\x1f"
_ASCII_SHAPES = _shapes("0-9", "A-Za-z", _ASCII_SPACE)
_SHAPES = _shapes(k.DIGIT, "A-Z", k.WS)


def _any_of(d: str, shapes: dict[str, str], more: str = "") -> str:
    return f"(?=[{d}])(?:{'|'.join(shapes.values())}{more})"


_ASCII_CANDIDATE = _any_of("0-9", _ASCII_SHAPES)
_CANDIDATE = _any_of(k.DIGIT, _SHAPES)
# In raw text a dropped ".0" may still join the digits before it to what follows.
_ASCII_RAW_CANDIDATE = _any_of(
    "0-9", _ASCII_SHAPES, rf"|[0-9]\.0[{_ASCII_SPACE}]*+[A-Za-z*]"
)
_MIN_IDENTIFIER_CHARS = 8


def may_hold_identifier(text: Column | str) -> Column:
    """Cheap test on *raw* text that no identifier, plain or masked, can fail.

    Length first, then one linear regex; text outside ASCII only needs something
    that can become a digit, because normalisation still lies ahead of it.
    """
    text = as_col(text)
    return F.when(
        is_ascii(text),
        (F.length(text) >= _MIN_IDENTIFIER_CHARS) & text.rlike(_ASCII_RAW_CANDIDATE),
    ).otherwise(text.rlike(rf"[0-9]|{_MAY_BECOME_DIGIT}"))


def is_candidate(text: Column | str) -> Column:
    """The same test for normalised text."""
    text = as_col(text)
    return (F.length(text) >= _MIN_IDENTIFIER_CHARS) & F.when(
        is_ascii(text), text.rlike(_ASCII_CANDIDATE)
    ).otherwise(F.upper(text).rlike(_CANDIDATE))


def has_shape(text: Column, upper: Column, shape: str) -> Column:
    """Whether normalised text shows one of the shapes above."""
    return F.when(is_ascii(text), text.rlike(_ASCII_SHAPES[shape])).otherwise(
        upper.rlike(_SHAPES[shape])
    )
