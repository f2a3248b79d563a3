"""The scan written again in SQL for DuckDB, as common table expressions.

RE2 has no look-around, so isolated runs are taken as maximal runs and then filtered.
"""

from __future__ import annotations

from querybook.people import LETTERS, WIDE_COLUMNS, WIDE_SQL, base_sql

# Verhoeff's tables as published (fixed values), written out here to be independent of
# the rule the library builds them by.
PRODUCT = (
    "0123456789" "1234067895" "2340178956" "3401289567" "4012395678"
    "5987604321" "6598710432" "7659821043" "8765932104" "9876543210"
)
POSITION = (
    "0123456789" "1576283094" "5803796142" "8916043527"
    "9453126870" "4286573901" "2793806415" "7046913258"
)
INVERSE = "0432156789"
BASE36 = "0123456789" + LETTERS


def verhoeff_state(number: str, start: int) -> str:
    """State after all digits of *number*, its last digit at position *start*."""
    digit = f"cast(substr({number}, cast(length({number}) - i as int), 1) as bigint)"
    place = f"cast(substr('{POSITION}', cast(((i + {start}) % 8) * 10 + {digit} + 1 as int), 1) as bigint)"
    step = f"cast(substr('{PRODUCT}', cast(c * 10 + {place} + 1 as int), 1) as bigint)"
    return f"list_reduce(range(0, cast(length({number}) as bigint)), lambda c, i: {step}, cast(0 as bigint))"


def verhoeff_digit(prefix: str) -> str:
    return f"substr('{INVERSE}', cast({verhoeff_state(prefix, 1)} + 1 as int), 1)"


def gstin_value(prefix: str) -> str:
    """Value of the check character of a 14-character prefix."""
    value = f"(instr('{BASE36}', substr({prefix}, cast(i + 1 as int), 1)) - 1) * (1 + i % 2)"
    total = (
        f"list_sum(list_transform(range(0, 14), lambda i: cast(({value}) // 36 + ({value}) % 36 as bigint)))"
    )
    return f"cast((36 - {total} % 36) % 36 as bigint)"


PEOPLE = f"""
base as ({base_sql()}),
checked as (
  select *, {verhoeff_digit("prefix11")} as va, {gstin_value("prefix14")} as vg from base
),
people as (
  select *,
    concat(prefix11, cast((cast(va as bigint) + case when id % 5 = 0 then 1 else 0 end) % 10 as varchar)) as aadhaar_no,
    concat(prefix14, substr('{BASE36}', cast((vg + case when id % 5 = 0 then 1 else 0 end) % 36 + 1 as int), 1)) as gstin
  from checked
),
wide as ({WIDE_SQL})
"""

# --- cells ------------------------------------------------------------------------------
_CONTEXT = "concat_ws(' ', " + ", ".join(f"nullif(trim({c}), '')" for c in WIDE_COLUMNS) + ")"
PEOPLE_CELLS = (
    "cells as (\n"
    + "\n union all ".join(
        f"select source as file, id as r, {i} as ord, '{c}' as col, trim({c}) as t, "
        f"{_CONTEXT} as ctx from wide where trim({c}) <> ''"
        for i, c in enumerate(WIDE_COLUMNS)
    )
    + ")"
)
DOCUMENT_CELLS = """
cells as (
  select source as file, doc_id as r, 0 as ord, 'text' as col, trim(text) as t, text as ctx
  from documents where trim(text) <> ''
)
"""

# --- header and label patterns (ASCII part) ------------------------------------------------
HEADERS = (
    ("AADHAAR", r"\b(aadhaar|aadhar|adhar|aadhr|uid)\b|\bunique\s*id(entification)?\b"),
    ("PAN", r"\bpan\b|\bpermanent\s*account\s*(no|num|number)?\b|\bincome\s*tax\s*(no|num|number|id)?\b"),
    ("GSTIN", r"\b(gstin?|gst\s*(no|num|number|id)?)\b|\bgoods\s*(and|&)\s*services?\s*tax\b"),
    ("IN_MOBILE", r"\b(mobile|mob|phone|ph|tel|cell|contact)\s*(no|num|number)?\b|\b(whatsapp|wa)\s*(no|num|number)?\b"),
    ("VOTER_ID", r"\b(voter\s*id|epic|voter\s*no|elector\s*photo)\b"),
    ("PASSPORT", r"\b(passport\s*no|passport\s*num|passport\s*number|ppt\s*no)\b"),
    ("BANK_ACCOUNT", r"\b(account|acct|acc)\s*(no|num|number)?\b"),
    ("IFSC", r"\b(ifsc|ifsc\s*code)\b"),
)
LABELS = (
    ("AADHAAR", r"aadhaar|aadhar|adhar|uid|unique\s*id"),
    ("BANK_ACCOUNT", r"account|acct|acc"),
    ("GSTIN", r"gstin?|gst"),
    ("IFSC", r"ifsc"),
    ("IN_MOBILE", r"mob(ile)?|phone|ph|tel|contact|cell|whatsapp|wa"),
    ("PAN", r"pan|permanent\s*account"),
)
PENALTY = r"\b(sl\s*no|invoice|ref\s*no|order\s*no|txn|serial|seq|qty|item|transaction)\b"
NEIGHBOURS = (
    r"\b(name|address|street|road|nagar|marg|flat|sector|pincode|pin|district|state|city|"
    r"email|customer|patient|employee|holder)\b"
)


def column_entity(name: str) -> str:
    words = f"translate({name}, '_-.', '   ')"
    cases = " ".join(f"when regexp_matches({words}, '(?i){p}') then '{e}'" for e, p in HEADERS)
    return f"case {cases} end"


def penalised(name: str) -> str:
    return f"regexp_matches(translate({name}, '_-', '  '), '(?i){PENALTY}')"


def labelled(text: str, entity: str) -> str:
    pattern = dict(LABELS).get(entity)
    return f"regexp_matches({text}, '(?i){pattern}')" if pattern else "false"


def dense(text: str) -> str:
    """Row density. Letters outside ASCII count as word characters, so they become one first."""
    t = f"regexp_replace({text}, '[À-ÿ]', 'z', 'g')"
    return (
        rf"(regexp_matches({t}, '\b[1-9][0-9]{{5}}\b') or regexp_matches({t}, '\b[6-9][0-9]{{9}}\b')"
        rf" or regexp_matches({t}, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}\b')"
        rf" or regexp_matches({t}, '(?i){NEIGHBOURS}'))"
    )


# --- chunks -----------------------------------------------------------------------------
_MARKED = (
    r"regexp_replace(regexp_replace({t}, '([0-9])/', '\1' || chr(1), 'g'), '/([0-9])', chr(1) || '\1', 'g')"
)
PARTS = (
    "list_filter(list_transform(string_split_regex("
    + _MARKED.format(t="t")
    + r", '[,;|\\]+|/'), lambda p: trim(replace(p, chr(1), '/'), ' ' || chr(9) || chr(10) || chr(13))), "
    "lambda p: length(p) >= 5)"
)
SPLITS = r"regexp_matches(t, '[,;|\\]') or regexp_matches(" + _MARKED.format(t="t") + ", '/')"


def whole_floats(text: str) -> str:
    """Drop ``.0``; applied twice, because a match takes the character after it along."""
    return rf"regexp_replace({text}, '(^|[^0-9.])([0-9]+)\.0($|[^0-9.])', '\1\2\3', 'g')"


def chunks_sql(cells: str = "cells") -> str:
    return f"""
clean as (
  select * replace ({whole_floats(whole_floats("t"))} as t) from {cells}
),
chunked as (
  select file, r, ord, col, ctx,
         unnest(case when {SPLITS} then list_concat([t], {PARTS}) else [t] end) as chunk,
         unnest(range(0, cast(len(case when {SPLITS} then list_concat([t], {PARTS}) else [t] end) as bigint))) as chunk_no
  from clean
),
chunks as (
  select row_number() over () as cid, *, upper(chunk) as up,
    regexp_replace(chunk, '[\\s\\-\\x{{2013}}\\x{{2014}}./_|]+', '', 'g') as da,
    regexp_replace(chunk, '[\\s\\-\\x{{2013}}\\x{{2014}}./_|()]+', '', 'g') as dm
  from chunked where regexp_matches(chunk, '[0-9]')
)
"""


REPEATED = "|".join(str(d) * 8 for d in range(10))
BANKS = (
    "SBIN KKBK HDFC ICIC UTIB PUNB ANDB CNRB BARB BKID CBIN CORP DENA IOBA MAHB ORBC PSIB SCBL "
    "SYND UBIN UCBA VIJB YESB IDIB IDFC RATN FDRL KVBL TMBL DCBL BDBL APGB RNSB COSB"
).split()
ENTITIES = (
    "AADHAAR", "GSTIN", "IFSC", "BANK_ACCOUNT", "IN_MOBILE", "PAN", "PASSPORT", "VOTER_ID",
)
CELL_ENTITIES = ("AADHAAR", "GSTIN", "IN_MOBILE", "PAN", "PASSPORT", "VOTER_ID")


def _runs(text: str, pattern: str) -> str:
    """Lines (cid, i, v): all matches of a pattern, numbered."""
    found = f"regexp_extract_all({text}, '{pattern}', 0)"
    return (
        f"select cid, chunk, unnest({found}) as v, "
        f"unnest(range(0, cast(len({found}) as bigint))) as i from chunks"
    )


def matches_sql(entities: tuple[str, ...] = ENTITIES, masked: bool = True) -> str:
    guard = (
        r"not regexp_matches(chunk, '[₹$€£¥]|(?i:rs|inr)') and not regexp_matches(chunk, "
        r"'[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}') and not regexp_matches(chunk, '(?i)(inv|ord|ref|txn|id)[\-#:]?\s*[0-9]')"
    )
    known = ", ".join(f"'{b}'" for b in BANKS)
    gstin_ok = f"substr('{BASE36}', cast({gstin_value('v')} + 1 as int), 1) = substr(v, 15, 1)"
    parts = {
        "AADHAAR": f"""
  select cid, 'AADHAAR' as entity, v as raw, concat('XXXX XXXX ', right(v, 4)) as masked,
         case when {verhoeff_state("v", 0)} = 0 then 'HIGH' else 'MEDIUM' end as conf, 0 as rec, i
  from (select cid, i, ltrim(v, '+') as v, v as run from ({_runs("da", "[+]?[0-9]+")}) x) y
  where length(v) = 12 and v >= '2' and not regexp_matches(v, '^91[6-9]')
    and not (run like '+91%') and not regexp_matches(v, '{REPEATED}')""",
        "GSTIN": rf"""
  select cid, 'GSTIN', v, concat(left(v, 2), 'XXXXXXXXXX', substr(v, 13, 3)),
         case when cast(left(v, 2) as int) not between 1 and 38 then 'LOW'
              when {gstin_ok} then 'HIGH' else 'MEDIUM' end, 1, i
  from ({_runs("up", r"\b[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b")}) x""",
        "IFSC": f"""
  select cid, 'IFSC', v, concat(left(v, 4), '0XXXXXX'),
         case when left(v, 4) in ({known}) then 'MEDIUM' else 'LOW' end, 2, i
  from ({_runs("up", "[A-Z0-9]+")}) x where regexp_full_match(v, '[A-Z]{{4}}0[A-Z0-9]{{6}}')""",
        "BANK_ACCOUNT": f"""
  select cid, 'BANK_ACCOUNT', v, concat(repeat('X', length(v) - 4), right(v, 4)), 'LOW', 3, i
  from ({_runs("chunk", "[0-9]+")}) x
  where (length(v) = 9 or length(v) between 11 and 18) and v not like '0%'""",
        "IN_MOBILE": f"""
  select cid, 'IN_MOBILE', v, concat('XXXXXX', right(v, 4)), 'MEDIUM', 4, i + 1000000 * coded
  from (
    select *, row_number() over (partition by cid, right(v, 10) order by coded, i) as n from (
      select cid, i, case when regexp_full_match(v, '[+]?91[6-9][0-9]{{9}}') then v else ltrim(v, '+') end as v,
             case when regexp_full_match(v, '[+]?[6-9][0-9]{{9}}') then 1 else 0 end as coded
      from ({_runs("dm", "[+]?[0-9]+")}) x
      where regexp_full_match(v, '[+]?(91|0)?[6-9][0-9]{{9}}') and {guard}
    ) y
  ) z where n = 1""",
        "PAN": rf"""
  select cid, 'PAN', v, concat('XXXXX', substr(v, 6, 4), 'X'),
         case when substr(v, 4, 1) in ('A','B','C','F','G','H','L','J','P','T','K') then 'HIGH' else 'MEDIUM' end,
         5, i
  from (
    select cid, regexp_replace(v, '\s+', '', 'g') as v,
           min(i + case when regexp_matches(v, '\s') then 1000000 else 0 end) as i
    from ({_runs("up", r"\b[A-Z]{3}\s*[A-Z]\s*[A-Z]\s*[0-9]{4}\s*[A-Z]\b")}) x group by 1, 2
  ) y where substr(v, 4, 1) not in ('Z', 'Q')""",
        "PASSPORT": f"""
  select cid, 'PASSPORT', v, concat(left(v, 1), 'XXXX', right(v, 3)), 'MEDIUM', 6, i
  from ({_runs("up", "[A-Z0-9]+")}) x where regexp_full_match(v, '[A-NPR-WYZ][0-9]{{7}}')""",
        "VOTER_ID": f"""
  select cid, 'VOTER_ID', v, concat(left(v, 3), 'XXXX', right(v, 3)), 'MEDIUM', 7, i
  from ({_runs("up", "[A-Z0-9]+")}) x where regexp_full_match(v, '[A-Z]{{3}}[0-9]{{7}}')""",
    }
    chosen = [parts[e] for e in ENTITIES if e in entities]
    text = "found(cid, entity, raw, masked, conf, rec, i) as (" + "\n  union all".join(chosen) + "\n)"
    if masked:
        gap = r"[\s\-]*"
        aadhaar = (
            rf"(?i)X{{4}}{gap}X{{4}}{gap}[0-9]{{4}}|[*]{{4}}{gap}[*]{{4}}{gap}[0-9]{{4}}"
            rf"|X{{8}}{gap}[0-9]{{4}}|[0-9]{{4}}{gap}X{{4}}{gap}X{{4}}"
        )
        pan = r"[A-Z*]{5}[0-9]{4}[A-Z*]|[A-Z]{3}[A-Z*]{2}[0-9]{4}[A-Z]"
        one = r"(?:^|[^A-Z0-9])([A-Z]{3}[X*]{4}[0-9]{3})|([A-Z]{3}[0-9]{3}[X*]{4})"
        two = r"(?:^|[^A-Z0-9])([A-Z][X*]{4}[0-9]{3})"

        def groups(pattern: str, n: int) -> str:
            lists = [f"regexp_extract_all(up, '{pattern}', {g})" for g in range(1, n + 1)]
            value = f"unnest({lists[0]})" if n == 1 else f"unnest(list_transform(list_zip({', '.join(lists)}), lambda z: concat(z[1], z[2])))"
            return f"select cid, {value} as v, unnest(range(0, cast(len({lists[0]}) as bigint))) as i from chunks"

        text += f""",
hidden as (
  select cid, 'AADHAAR_MASKED' as entity, v as raw, v as masked, 'MEDIUM' as conf, 100 as rec, i
  from ({_runs("chunk", aadhaar)}) x
  union all
  select cid, 'PAN_MASKED', v, v, 'LOW', 101, i from ({_runs("up", pan)}) x
  where regexp_matches(v, '[*X]') and not exists (
    select 1 from found f where f.cid = x.cid and f.entity = 'PAN' and f.raw = x.v)
  union all
  select cid, 'VOTER_ID_MASKED', v, v, 'LOW', 102, i from ({groups(one, 2)}) x
  union all
  select cid, 'PASSPORT_MASKED', v, v, 'LOW', 103, i from ({groups(two, 1)}) x
)"""
    return text


def findings_sql(
    cells: str,
    entities: tuple[str, ...] = ENTITIES,
    masked: bool = True,
    scope: str = "source",
    context: bool = True,
    penalty: bool = True,
) -> str:
    """CTEs up to ``findings(file, row, column, entity_type, masked_value, confidence, ...)``."""
    labels = " ".join(
        f"when entity = '{e}' then {labelled('chunk', e)}" for e, _ in LABELS if e in entities
    )
    support = f"(coalesce(ce = entity, false) or (case {labels} else false end)"
    support += " or is_dense)" if context else ")"
    low = "neg" if penalty else "false"
    keys = {"source": "file, entity, raw", "cell": "file, r, ord, entity, raw"}[scope]
    hidden = "union all select * from hidden" if masked else ""
    return f"""
{cells},
{chunks_sql()},
{matches_sql(entities, masked)},
located as (
  select m.entity, m.raw, m.masked, m.conf, m.rec, m.i, c.file, c.r, c.ord, c.col, c.chunk, c.chunk_no,
         {column_entity("c.col")} as ce, {penalised("c.col")} as neg, {dense("c.ctx")} as is_dense
  from (select * from found {hidden}) m join chunks c on m.cid = c.cid
),
graded as (
  select *, case when rec >= 100 then conf when {low} then 'LOW'
    when {support} then case conf when 'LOW' then 'MEDIUM' else 'HIGH' end else conf end as confidence
  from located
),
findings as (
  select file, r as row, col as column, entity as entity_type, masked as masked_value, confidence,
         ord, chunk_no, rec, i
  from (select *, row_number() over (partition by {keys} order by r, ord, chunk_no, rec, i) as n from graded) q
  where n = 1
)
"""


def without_values_sql(documents: str = "documents") -> str:
    """CTEs ``cleaned(doc_id, text, clean)``: documents with all occurrences of the values ``found`` in them redacted.

    One value after another, the longest first, each replaced twice as a match takes the characters around it along.
    """
    gap = r"[\s\-\x{2013}\x{2014}./_|()]*"
    spaced = "array_to_string(string_split(key, ''), '{}')"
    rank = " ".join(
        f"when '{e}' then {i}"
        for i, e in enumerate(("AADHAAR", "PAN", "GSTIN", "IN_MOBILE", "VOTER_ID", "PASSPORT", "BANK_ACCOUNT", "IFSC"))
    )
    return rf"""
spelt as (
  select r as doc_id, entity, case entity {rank} end as rank, upper(case when entity = 'IN_MOBILE' then right(raw, 10) else raw end) as key
  from found join chunks using (cid)
),
valued as (
  select doc_id, key, arg_min(entity, rank) as entity from spelt group by all
),
patterned as (
  select doc_id, key, concat('[REDACTED_', entity, ']') as mark, case
      when entity = 'AADHAAR' then concat('(?i)(^|[^0-9])', {spaced.format(gap)}, '($|[^0-9])')
      when entity = 'IN_MOBILE' then concat('(?i)(^|[^0-9])(?:[+]?91|0)?', {spaced.format(gap)}, '($|[^0-9])')
      when entity = 'BANK_ACCOUNT' then concat('(?i)(^|[^0-9])', key, '($|[^0-9])')
      when entity = 'PAN' then concat('(?i)(^|[^A-Z0-9_])', {spaced.format(chr(92) + "s*")}, '($|[^A-Z0-9_])')
      when entity = 'GSTIN' then concat('(?i)(^|[^A-Z0-9_])', key, '($|[^A-Z0-9_])')
      else concat('(?i)(^|[^A-Z0-9])', key, '($|[^A-Z0-9])') end as pattern
  from valued
),
listed as (
  select doc_id, list(concat(pattern, chr(1), mark) order by length(key) desc, key) as steps from patterned group by 1
),
cleaned as (
  select doc_id, text, case when steps is null then text else list_reduce(steps, lambda t, x: regexp_replace(
      regexp_replace(t, split_part(x, chr(1), 1), concat('\1', split_part(x, chr(1), 2), '\2'), 'g'),
      split_part(x, chr(1), 1), concat('\1', split_part(x, chr(1), 2), '\2'), 'g'), text) end as clean
  from {documents} left join listed using (doc_id)
)"""
