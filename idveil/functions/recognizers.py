"""Identifier recognizers: text Column to an array of matches.

Every recognizer returns ``array<struct<entity_type, raw_value, masked_value,
confidence, extra>>`` in order of occurrence. Patterns are linear on whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from idveil import constants as k
from idveil.functions.checksums import gstin_valid, verhoeff_valid
from idveil.functions.columns import as_col, drop_spaces, find_all, first_per_key, let

D = k.DIGIT
MATCH_TYPE = (
    "array<struct<entity_type:string,raw_value:string,masked_value:string,"
    "confidence:string,extra:map<string,string>>>"
)


def no_matches() -> Column:
    return F.array().cast(MATCH_TYPE)


def _match(
    entity: str, raw: Column, masked: Column, confidence: Column, extra: Column | None = None
) -> Column:
    if extra is None:
        extra = F.lit(None).cast("map<string,string>")
    return F.struct(
        F.lit(entity).alias("entity_type"),
        raw.alias("raw_value"),
        masked.alias("masked_value"),
        confidence.alias("confidence"),
        extra.alias("extra"),
    )


def _matches(values: Column, build: Callable[[Column], Column]) -> Column:
    return F.transform(values, build)


def _head(value: Column, n: int) -> Column:
    return F.substring(value, 1, n)


def _tail(value: Column, n: int) -> Column:
    return F.substring(value, -n, n)


# --- masks -----------------------------------------------------------------------
def mask_aadhaar(value: Column | str) -> Column:
    return F.concat(F.lit("XXXX XXXX "), _tail(as_col(value), 4))


def mask_pan(value: Column | str) -> Column:
    return F.concat(F.lit("XXXXX"), F.substring(as_col(value), 6, 4), F.lit("X"))


def mask_gstin(value: Column | str) -> Column:
    value = as_col(value)
    return F.concat(_head(value, 2), F.lit("X" * 10), F.substring(value, 13, 3))


def mask_mobile(value: Column | str) -> Column:
    return F.concat(F.lit("XXXXXX"), _tail(as_col(value), 4))


def mask_account(value: Column | str) -> Column:
    """All but the last four digits; a value of four or fewer is masked whole."""
    value = as_col(value)
    size = F.length(value)
    return F.when(size <= 4, F.repeat(F.lit("X"), size)).otherwise(
        F.concat(F.repeat(F.lit("X"), size - 4), _tail(value, 4))
    )


def mask_ifsc(value: Column | str) -> Column:
    return F.concat(_head(as_col(value), 4), F.lit("0XXXXXX"))


def mask_voter_id(value: Column | str) -> Column:
    value = as_col(value)
    return F.concat(_head(value, 3), F.lit("XXXX"), _tail(value, 3))


def mask_passport(value: Column | str) -> Column:
    value = as_col(value)
    return F.concat(_head(value, 1), F.lit("XXXX"), _tail(value, 3))


# --- Aadhaar -----------------------------------------------------------------------
AADHAAR_SEPARATORS = rf"[{k.WS}\-–—./_|]+"


def strip_aadhaar_separators(text: Column | str) -> Column:
    return F.regexp_replace(as_col(text), AADHAAR_SEPARATORS, "")


def strip_phone_prefixes(text: Column | str) -> Column:
    """Drop +91, 91 and trunk 0 in front of a ten-digit number."""
    text = F.regexp_replace(as_col(text), rf"\+91(?={D}{{10}}(?!{D}))", "")
    text = F.regexp_replace(text, rf"(?<!{D})91(?=[6-9]{D}{{9}}(?!{D}))", "")
    return F.regexp_replace(text, rf"(?<!{D})0(?=[6-9]{D}{{9}}(?!{D}))", "")


def plausible_aadhaar(number: Column | str) -> Column:
    """No run of eight equal digits, no number that only counts up or down.

    Twelve digits cannot count in steps of one (there are ten), so the second
    test never fires on a full number; it is kept because the rule states it.
    """
    number = as_col(number)
    counting = F.lit("0123456789").contains(number) | F.lit("9876543210").contains(number)
    return ~number.rlike(rf"({D})\1{{7}}") & ~counting


def find_aadhaar(text: Column | str, stripped: Column | None = None) -> Column:
    if stripped is None:
        stripped = strip_phone_prefixes(strip_aadhaar_separators(text))
    found = F.filter(
        find_all(stripped, rf"(?<!{D})[2-9]{D}{{11}}(?!{D})"), plausible_aadhaar
    )
    return _matches(
        found,
        lambda v: _match(
            "AADHAAR",
            v,
            mask_aadhaar(v),
            F.when(verhoeff_valid(v), F.lit("HIGH")).otherwise(F.lit("MEDIUM")),
        ),
    )


# --- PAN -----------------------------------------------------------------------------
_PAN_PATTERN = (
    r"(?:(?<=([/\\])[\s\S]{0,2}))?"  # 1: a path separator up to three characters before
    + k.WORD_START
    + rf"([A-Z]{{3}}[{k.WS}]*[A-Z][{k.WS}]*[A-Z][{k.WS}]*{D}{{4}}[{k.WS}]*[A-Z])"
    + k.WORD_END
    + r"(?=(@)?)"  # 3: an address follows
)


def find_pan(text: Column | str, upper: Column | None = None) -> Column:
    """Compact occurrences come before spaced ones, and the first of a value decides.

    A value whose first occurrence sits in an e-mail address or a path is dropped
    even if it occurs again elsewhere in the text.
    """
    if upper is None:
        upper = F.upper(as_col(text))

    def item(hit: Column, i: Column) -> Column:
        raw = drop_spaces(hit["value"])
        spaced = F.length(raw) != F.length(hit["value"])
        return F.struct(
            raw.alias("key"),
            F.struct(spaced.alias("spaced"), i.alias("at")).alias("pos"),
            ((hit["path"] != "") | (hit["mail"] != "")).alias("guarded"),
        )

    hits = F.arrays_zip(
        find_all(upper, _PAN_PATTERN, 2).alias("value"),
        find_all(upper, _PAN_PATTERN, 1).alias("path"),
        find_all(upper, _PAN_PATTERN, 3).alias("mail"),
    )
    holder = lambda v: F.substring(v, 4, 1)
    firsts = let(F.transform(hits, item), first_per_key)
    good = F.filter(
        firsts, lambda x: ~x["guarded"] & ~holder(x["key"]).isin(*k.PAN_NEVER_HOLDERS)
    )
    labels = F.create_map(*[F.lit(x) for pair in k.PAN_HOLDERS.items() for x in pair])

    def build(x: Column) -> Column:
        known = holder(x["key"]).isin(*k.PAN_HOLDERS)
        return _match(
            "PAN",
            x["key"],
            mask_pan(x["key"]),
            F.when(known, F.lit("HIGH")).otherwise(F.lit("MEDIUM")),
            F.when(
                known,
                F.create_map(
                    F.lit("holder_type"), F.try_element_at(labels, holder(x["key"]))
                ),
            ),
        )

    return _matches(good, build)


# --- GSTIN ---------------------------------------------------------------------------
_GSTIN_PATTERN = (
    k.WORD_START + rf"{D}{{2}}[A-Z]{{5}}{D}{{4}}[A-Z][1-9A-Z]Z[0-9A-Z]" + k.WORD_END
)


def find_gstin(text: Column | str, upper: Column | None = None) -> Column:
    if upper is None:
        upper = F.upper(as_col(text))

    def build(v: Column) -> Column:
        state = _head(v, 2)
        confidence = (
            F.when(~state.isin(*k.GSTIN_STATES), F.lit("LOW"))
            .when(gstin_valid(v), F.lit("HIGH"))
            .otherwise(F.lit("MEDIUM"))
        )
        return _match(
            "GSTIN", v, mask_gstin(v), confidence, F.create_map(F.lit("state_code"), state)
        )

    return _matches(find_all(upper, _GSTIN_PATTERN), build)


# --- mobile ----------------------------------------------------------------------------
MOBILE_SEPARATORS = rf"[{k.WS}\-–—./_|()]+"
_CURRENCY = r"[₹$€£¥]|(?i:rs|inr)"
_NOISE = (
    rf"{D}{{4}}[-/]{D}{{2}}[-/]{D}{{2}}"
    rf"|(?i:inv|ord|ref|txn|id)[\-#:]?[{k.WS}]*{D}"
)


def strip_mobile_separators(text: Column | str) -> Column:
    return F.regexp_replace(as_col(text), MOBILE_SEPARATORS, "")


def looks_like_amount_or_reference(text: Column | str) -> Column:
    """A currency sign, a date or a document number anywhere rules out mobiles."""
    text = as_col(text)
    return text.rlike(_CURRENCY) | text.rlike(_NOISE)


def find_mobile(text: Column | str, stripped: Column | None = None) -> Column:
    """Numbers with a country code or trunk 0 first, then bare ones, once per number."""
    text = as_col(text)
    if stripped is None:
        stripped = strip_mobile_separators(text)
    coded = find_all(stripped, rf"(?<!{D})(?:\+?91|0)[6-9]{D}{{9}}(?!{D})")
    bare = find_all(stripped, rf"(?<!{D})[6-9]{D}{{9}}(?!{D})")
    items = F.transform(
        F.concat(coded, bare),
        lambda v, i: F.struct(_tail(v, 10).alias("key"), i.alias("pos"), v.alias("raw")),
    )
    found = F.transform(
        let(items, first_per_key),
        lambda x: _match("IN_MOBILE", x["raw"], mask_mobile(x["key"]), F.lit("MEDIUM")),
    )
    return F.when(looks_like_amount_or_reference(text), no_matches()).otherwise(
        found.cast(MATCH_TYPE)
    )


# --- bank ------------------------------------------------------------------------------
def find_ifsc(text: Column | str, upper: Column | None = None) -> Column:
    if upper is None:
        upper = F.upper(as_col(text))

    def build(v: Column) -> Column:
        bank = _head(v, 4)
        confidence = F.when(bank.isin(*k.BANK_CODES), F.lit("MEDIUM")).otherwise(F.lit("LOW"))
        return _match("IFSC", v, mask_ifsc(v), confidence, F.create_map(F.lit("bank_code"), bank))

    return _matches(find_all(upper, r"(?<![A-Z0-9])[A-Z]{4}0[A-Z0-9]{6}(?![A-Z0-9])"), build)


def find_bank_account(text: Column | str) -> Column:
    """Isolated runs of 9 or 11 to 18 digits without a leading zero."""
    pattern = rf"(?<!{D})(?!0)(?:{D}{{11,18}}|{D}{{9}})(?!{D})"
    return _matches(
        find_all(as_col(text), pattern),
        lambda v: _match("BANK_ACCOUNT", v, mask_account(v), F.lit("LOW")),
    )


# --- voter card and passport --------------------------------------------------------------
def _isolated(upper: Column, shape: str) -> Column:
    return find_all(upper, rf"(?<![A-Z0-9]){shape}(?![A-Z0-9])")


def find_voter_id(text: Column | str, upper: Column | None = None) -> Column:
    if upper is None:
        upper = F.upper(as_col(text))
    return _matches(
        _isolated(upper, "[A-Z]{3}[0-9]{7}"),
        lambda v: _match("VOTER_ID", v, mask_voter_id(v), F.lit("MEDIUM")),
    )


def find_passport(text: Column | str, upper: Column | None = None) -> Column:
    if upper is None:
        upper = F.upper(as_col(text))
    return _matches(
        _isolated(upper, "[A-NPR-WYZ][0-9]{7}"),
        lambda v: _match("PASSPORT", v, mask_passport(v), F.lit("MEDIUM")),
    )


# --- values someone has masked already -----------------------------------------------------
_GAP = rf"[{k.WS}\-]*"
MASKED_PATTERNS = {
    "AADHAAR_MASKED": (
        rf"X{{4}}{_GAP}X{{4}}{_GAP}{D}{{4}}"
        rf"|\*{{4}}{_GAP}\*{{4}}{_GAP}{D}{{4}}"
        rf"|X{{8}}{_GAP}{D}{{4}}"
        rf"|{D}{{4}}{_GAP}X{{4}}{_GAP}X{{4}}"
    ),
    "PAN_MASKED": rf"[A-Z*]{{5}}{D}{{4}}[A-Z*]|[A-Z]{{3}}[A-Z*]{{2}}{D}{{4}}[A-Z]",
    "VOTER_ID_MASKED": (
        rf"(?<![A-Z0-9])[A-Z]{{3}}[X*]{{4}}{D}{{3}}|[A-Z]{{3}}{D}{{3}}[X*]{{4}}"
    ),
    "PASSPORT_MASKED": rf"(?<![A-Z0-9])[A-Z][X*]{{4}}{D}{{3}}",
}


def find_masked(
    text: Column | str, upper: Column | None = None, clear_pans: Column | None = None
) -> Column:
    """Aadhaar, PAN, voter and passport numbers that are partly masked already.

    The PAN shape also fits a *clear* PAN that merely contains an X. Give the PANs
    found in the same text as *clear_pans* to leave those out, so that no clear
    value is reported as a masked one.
    """
    text = as_col(text)
    if upper is None:
        upper = F.upper(text)

    def verbatim(values: Column, entity: str, confidence: str) -> Column:
        return _matches(values, lambda v: _match(entity, v, v, F.lit(confidence)))

    pans = F.filter(find_all(upper, MASKED_PATTERNS["PAN_MASKED"]), lambda v: v.rlike("[*X]"))
    if clear_pans is not None:
        pans = F.when(
            (F.size(pans) > 0) & (F.size(clear_pans) > 0), F.array_except(pans, clear_pans)
        ).otherwise(pans)
    return F.concat(
        verbatim(
            find_all(text, "(?i)" + MASKED_PATTERNS["AADHAAR_MASKED"]), "AADHAAR_MASKED", "MEDIUM"
        ),
        verbatim(pans, "PAN_MASKED", "LOW"),
        verbatim(find_all(upper, MASKED_PATTERNS["VOTER_ID_MASKED"]), "VOTER_ID_MASKED", "LOW"),
        verbatim(find_all(upper, MASKED_PATTERNS["PASSPORT_MASKED"]), "PASSPORT_MASKED", "LOW"),
    )
