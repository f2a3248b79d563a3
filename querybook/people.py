"""Identifiers derived from the customer table, by SQL that Spark and DuckDB both accept.

Every 5th person has a wrong check digit, every 7th repeats the values of the fifth
person before, every 11th has the number in an invoice column instead, every 13th packs
two values into one note. Check digits are added per engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idveil.functions.checksums import gstin_check_digit, verhoeff_check_digit
from idveil.functions.columns import as_col
from idveil.plans.spread import spread

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _pick(alphabet: str, index: str, width: int = 1) -> str:
    n = len(alphabet) // width
    return f"substr('{alphabet}', cast(1 + {width} * (({index}) % {n}) as int), {width})"


def _digits(expression: str, width: int) -> str:
    return f"lpad(cast(({expression}) % {10**width} as string), {width}, '0')"


def base_sql(customer: str = "customer") -> str:
    """One line per customer with every identifier but its check digit."""
    pan = "concat({}, {}, {}, {}, {}, {}, {})".format(
        _pick(LETTERS, "k"),
        _pick(LETTERS, "k * 7"),
        _pick(LETTERS, "k * 11"),
        _pick("ABCFGHLJPTKZQD", "k"),
        _pick(LETTERS, "k * 5"),
        _digits("k * 37", 4),
        _pick(LETTERS, "k * 3"),
    )
    return f"""
select id, k, source, prefix11, pan_no, mobile,
       concat(lpad(cast(k % 40 as string), 2, '0'), pan_no, '1Z') as prefix14,
       cast(10000000000 + k * 982451653 % 89999999999 as string) as account_no,
       concat({_pick("HDFCSBINICICZZZZABCD", "k", 4)}, '0', {_digits("k * 77", 6)}) as ifsc,
       concat({_pick(LETTERS, "k * 3 + 1")}, {_pick(LETTERS, "k * 9 + 2")},
              {_pick(LETTERS, "k")}, {_digits("k * 9176", 7)}) as voter_id,
       concat({_pick(LETTERS, "k")}, {_digits("k * 3571", 7)}) as passport_no,
       segment, balance
from (
  select id, k, concat('src_', cast(id % 5 as string)) as source,
         concat(cast(2 + k % 8 as string), {_digits("k * 7368787 + 104729", 10)}) as prefix11,
         {pan} as pan_no,
         concat(cast(6 + k % 4 as string), {_digits("k * 736878713", 9)}) as mobile,
         c_mktsegment as segment, c_acctbal as balance
  from (
    select c_custkey as id, c_mktsegment, c_acctbal,
           case when c_custkey % 7 = 0 and c_custkey >= 5 then c_custkey - 5 else c_custkey end as k
    from {customer}
  ) a
) b
"""


# Columns of the wide table that are built from the identifiers by the same SQL on both sides.
WIDE_SQL = """
select id, source, case when id % 11 = 0 then null else aadhaar_no end as aadhaar_no, pan_no, gstin, mobile as phone_no, account_no, ifsc,
       voter_id, passport_no,
       case when id % 11 = 0 then aadhaar_no
            else concat('INV-', cast(id as string)) end as invoice_no,
       case when id % 13 = 0 then concat('PAN: ', pan_no, ', Mobile: ', mobile)
            when id % 13 = 1 then concat('UID ', substr(aadhaar_no, 1, 4), ' ',
                                         substr(aadhaar_no, 5, 4), '-', substr(aadhaar_no, 9, 4))
            when id % 13 = 2 then concat('+91 ', mobile)
            when id % 13 = 3 then concat('XXXX XXXX ', substr(aadhaar_no, 9, 4))
            when id % 13 = 4 then concat(substr(pan_no, 1, 3), '**', substr(pan_no, 6, 5))
            when id % 13 = 5 then concat('customer street ', cast(100000 + id as string))
            when id % 13 = 6 then ' '
            when id % 13 = 7 then concat(mobile, '.0')
            when id % 13 = 8 then concat('epic ', substr(voter_id, 1, 3), 'XXXX', substr(voter_id, 8, 3))
            when id % 13 = 9 then concat(substr(pan_no, 1, 3), ' ', substr(pan_no, 4, 2), ' ',
                                         substr(pan_no, 6, 4), ' ', substr(pan_no, 10, 1))
            when id % 13 = 10 then concat('acc ', account_no, '; ifsc ', ifsc)
            else null end as note
from people
"""

WIDE_COLUMNS = (
    "aadhaar_no", "pan_no", "gstin", "phone_no", "account_no", "ifsc", "voter_id",
    "passport_no", "invoice_no", "note",
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived identifiers with their check digits."""
    base = spark.sql(base_sql("{customer}"), customer=_table(spark, sf_dir, "customer"))
    bump = F.when(F.col("id") % 5 == 0, 1).otherwise(0)
    aadhaar_digit = (verhoeff_check_digit("prefix11").cast("int") + bump) % 10
    alphabet = F.lit("0123456789" + LETTERS)
    gstin_at = (F.position(gstin_check_digit("prefix14"), alphabet) - 1 + bump) % 36
    return base.select(
        "*",
        F.concat(as_col("prefix11"), aadhaar_digit.cast("string")).alias("aadhaar_no"),
        F.concat(as_col("prefix14"), F.substring(alphabet, gstin_at + 1, F.lit(1))).alias("gstin"),
    )


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per person with all identifiers as text columns."""
    return spark.sql(WIDE_SQL.replace("from people", "from {p}"), p=people(spark, sf_dir))
