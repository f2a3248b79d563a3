"""Line dedup by distinct-site spread: lines that many sites share are boilerplate and leave the documents.

Each line hash gets a HyperLogLog sketch of the sites it is on; sketches merge by aggregation, so a line that a
third of all rows hold sends one sketch per task. Where the estimate is too near the threshold to decide, the exact
number of distinct sites is counted for that hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idveil.llm.common import SPACES, let, table, written

#: A line on so many distinct sites is boilerplate.
MIN_SITES = 10
#: A document of whose characters a larger share is boilerplate is marked; it is cleaned like any other.
MOST_SHARE = 0.5
#: Documents with boilerplate whose line hashes are broadcast at most, and these hashes; more are joined by shuffle.
MAX_BROADCAST_DOCS, MAX_BROADCAST_HASHES = 200_000, 2_000_000
#: Base-2 logarithm of the sketch size; relative standard error 1.04 / sqrt(2 ** LG_K).
LG_K = 10
#: Estimates within so many standard errors of the threshold are counted exactly.
ERRORS = 5


def _key(line: Column) -> Column:
    """128-bit hash of a line with its white space made even; null for a line without words."""
    even = F.trim(F.regexp_replace(line, SPACES, " "))
    return F.when(even != "", F.unhex(F.md5(even)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _chars(lines: Column) -> Column:
    """Characters of the lines, spaces at their ends apart."""
    return F.aggregate(lines, F.lit(0), lambda n, x: n + F.length(F.trim(x)))


def hashed_lines(docs: DataFrame, site_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc (all columns), row, site, hashes (of the lines with words): the one pass over the texts that all counts share.

    To be written once: row is a number of this very reading.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(
        F.struct(*columns).alias("doc"),
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{site_col}`").cast("string").alias("site"),
        F.array_compact(F.transform(_lines(F.col(f"`{text_col}`")), _key)).alias("hashes"),
    )


def line_sites(hashed: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """hash, sketch of its sites, n_rows: one row per distinct line. Null sites are no sites."""
    return (
        hashed.where("site IS NOT NULL")
        .select("site", F.explode("hashes").alias("hash"))
        .groupBy("hash")
        .agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.count(F.lit(1)).alias("n_rows"))
    )


def spread_lines(hashed: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """hash of each line on min_sites distinct sites or more.

    A line with fewer rows than min_sites cannot be on so many sites and leaves before its estimate is taken.
    """
    margin = ERRORS * 1.04 / 2 ** (lg_k / 2)
    sketched = written(
        line_sites(hashed, lg_k)
        .where(F.col("n_rows") >= min_sites)
        .select("hash", F.hll_sketch_estimate("sketch").alias("estimate"))
    )
    sure = sketched.where(F.col("estimate") > min_sites * (1 + margin)).select("hash")
    near = sketched.where(F.abs(F.col("estimate") - min_sites) <= min_sites * margin).select("hash")
    exact = (
        hashed.where("site IS NOT NULL")
        .select("site", F.explode("hashes").alias("hash"))
        .join(near, "hash", "left_semi")
        .distinct()
        .groupBy("hash")
        .agg(F.count(F.lit(1)).alias("sites"))
        .where(F.col("sites") >= min_sites)
        .select("hash")
    )
    return sure.unionAll(exact)


def _free(name: str, taken: list[str]) -> str:
    """The name, with underscores behind it until no column has it (whatever the case)."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def drop_boilerplate(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    site_col: str = "source",
    text_col: str = "text",
    lg_k: int = LG_K,
    marked: bool = False,
) -> DataFrame:
    """docs with its text cleaned, and n_lines, n_removed; all its other columns stay as they were, whatever their names
    (a column called n_lines or n_removed stays, and the new one gets an underscore behind its name). Where marked,
    mostly_boilerplate follows: whether the lines removed had more than MOST_SHARE of the text's characters (spaces at the
    ends of lines apart), as in copies. It tells only; these documents are cleaned too.

    Lines end at a line feed; equal lines are those with equal words between white space. Lines without words are
    never boilerplate. Every line on min_sites sites or more leaves every document, also one that is left empty by it. A
    null text has no lines and stays null; a null site is no site. Repeated rows are cleaned each; ids do not
    matter. An empty table gives an empty result.
    """
    hashed = written(hashed_lines(docs, site_col, text_col))
    hits = written(
        hashed.select("row", F.explode("hashes").alias("hash"))
        .join(spread_lines(hashed, min_sites, lg_k), "hash", "left_semi")
        .groupBy("row")
        .agg(F.collect_set("hash").alias("gone"))
    )
    size = hits.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.size("gone")), F.lit(0)).alias("hashes")).first()
    few = size["docs"] <= MAX_BROADCAST_DOCS and size["hashes"] <= MAX_BROADCAST_HASHES
    # Beyond that, rows meet their hashes by row number, one to one.
    joined = hashed.select("doc", "row").join(F.broadcast(hits) if few else hits, "row", "left")
    text = F.col(f"doc.`{text_col}`")
    stays = F.filter(_lines(text), lambda x: F.coalesce(~F.array_contains("gone", _key(x)), F.lit(True)))
    # Documents without a hit, nearly all, are not taken apart.
    rows = joined.select("doc", F.when(F.col("gone").isNotNull(), stays).alias("stays"))
    hit = F.col("stays").isNotNull()
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(_lines(text)))
    cleaned = F.when(hit, F.array_join("stays", "\n")).otherwise(text)
    same = [cleaned.alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    added = [
        n_lines.alias(_free("n_lines", docs.columns)),
        F.when(hit, n_lines - F.size("stays")).otherwise(0).alias(_free("n_removed", docs.columns)),
    ]
    if marked:
        most = let(_chars(_lines(text)), lambda n: n - _chars(F.col("stays")) > MOST_SHARE * n)
        added.append(F.when(hit, most).otherwise(F.lit(False)).alias(_free("mostly_boilerplate", docs.columns)))
    return rows.select(*same, *added)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = drop_boilerplate(table(spark, sf_dir, "documents"), marked=True)
    return cleaned.select("doc_id", "text", "n_lines", "n_removed", "mostly_boilerplate")


OP8_SQL = rf"""
WITH l AS (
  SELECT doc_id, source, u.i AS i, u.line AS line,
         trim(regexp_replace(u.line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS even
  FROM (SELECT doc_id, source, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {{'i': i, 'line': x}})) AS u
        FROM documents WHERE text IS NOT NULL)
), spread AS (
  SELECT even FROM l WHERE even <> '' GROUP BY even HAVING count(DISTINCT source) >= {MIN_SITES}
), m AS (
  SELECT l.*, s.even IS NOT NULL AS gone FROM l LEFT JOIN spread s ON l.even = s.even
), d AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_gone,
         coalesce(sum(length(trim(line, ' '))) FILTER (gone), 0) AS gone_chars, sum(length(trim(line, ' '))) AS chars,
         string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS rest
  FROM m GROUP BY doc_id
)
SELECT documents.doc_id, CASE WHEN n_gone > 0 THEN coalesce(rest, '') ELSE text END AS text,
       coalesce(n_lines, 0)::INTEGER AS n_lines, coalesce(n_gone, 0)::INTEGER AS n_removed,
       coalesce(n_gone > 0 AND gone_chars > {MOST_SHARE} * chars, false) AS mostly_boilerplate
FROM documents LEFT JOIN d USING (doc_id)
"""
