"""Secret scans: fixed forms, and a battery of randomness tests under false-discovery control.

All of it is built-in expressions. One pass over the texts finds the fixed forms and the candidates (runs of encoding
characters), and tests each candidate under the encoding its characters suggest: chi-squared uniformity over the
alphabet, a runs test about the alphabet's middle, lag-1 serial correlation. A candidate that passes as random is
a discovery if the same three kinds of test, against the null of ordinary text in its encoding (chi-squared of the
letters' frequencies, runs of one class, serial vowels and consonants), reject that null together; a
Benjamini-Hochberg step, weighted by length, over all candidates of the corpus sets the limit from a histogram of
bounded size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idveil.llm.common import let, table, written

# The forms that are always spans.
_ANY_CASE = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_NAMES = "|".join([*map(_ANY_CASE, ["password", "passwd", "secret", "token"]), _ANY_CASE("api") + "_?" + _ANY_CASE("key")])
ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# For runs of one class, a least length inside the pattern finds the same matches as dropping short ones.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

#: Candidates: runs of encoding characters of this length at least, with letters and digits.
MIN_LENGTH = 16
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}={{0,2}}"
#: Share of ordinary tokens among the discoveries, at most.
FALSE_DISCOVERIES = 0.001
#: A candidate is not random if one of the three tests says so at this level (divided by three).
UNIFORMITY_LEVEL = 0.003
#: How often neighbouring characters of ordinary identifiers differ in class (capital, small, digit, other).
ORDINARY_SWITCHES = 0.2
#: How often just one of two neighbouring letters of ordinary text is a vowel; random letters have 0.31.
ORDINARY_TURNS = 0.6
#: Letters of ordinary text in groups from common to rare, and the groups' shares (English); those of hexadecimal digits.
LETTER_GROUPS = ("etaoinsr", "lhducmp", "fgywbvkxjqz"), (0.631, 0.225, 0.144)
HEX_GROUPS = ("ae", "cd", "bf"), (0.659, 0.224, 0.117)
#: Length at which a candidate has weight 1; longer ones weigh more in proportion.
WEIGHT_LENGTH = 32
#: Histogram of -log10(p / weight): bins of this width up to this value.
BIN, LAST_BIN = 0.1, 400

# Alphabets in the order of their values.
DIGITS, SMALL, CAPITALS = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+=*$", CAPITALS + "234567"),
    ("base36", "^[0-9a-z]+$", DIGITS + SMALL),
    ("BASE36", "^[0-9A-Z]+$", DIGITS + CAPITALS),
    ("base62", "^[0-9A-Za-z]+$", CAPITALS + SMALL + DIGITS),
    ("base64", "^[0-9A-Za-z+/]+=*$", CAPITALS + SMALL + DIGITS + "+/"),
    ("base64url", "^[0-9A-Za-z_-]+=*$", CAPITALS + SMALL + DIGITS + "-_"),
)


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as array of (start, end, value); code points, end exclusive."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def place(gaps: Column) -> Column:
        matches = F.arrays_zip(
            F.transform(F.slice(gaps, 1, F.size(gaps) - 1), F.length).alias("gap"),
            F.transform(whole, F.length).alias("size"),
            value.alias("value"),
        )
        none = F.array().cast("array<struct<start:int,end:int,value:string>>")
        state = F.struct(F.lit(0).alias("at"), none.alias("out"))

        def step(s: Column, m: Column) -> Column:
            start = s["at"] + m["gap"]
            end = start + m["size"]
            one = F.array(F.struct(start.alias("start"), end.alias("end"), m["value"].alias("value")))
            return F.struct(end.alias("at"), F.concat(s["out"], one).alias("out"))

        return F.aggregate(matches, state, step, lambda s: s["out"])

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), let(F.split(text, pattern, -1), place)).otherwise(none)


def _normal(z: Column) -> Column:
    """Upper tail of the normal distribution; logistic approximation, accurate to 0.0002."""
    near = 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))
    far = F.exp(-z * z / 2) / (z * math.sqrt(2 * math.pi))  # the tail's first term, from 3 on
    return F.when(z > 3, far).otherwise(near)


def _surprise(z: Column) -> Column:
    """-ln of the upper tail, also where the tail itself is no number above 0 any more."""
    return F.when(z > 3, z * z / 2 + F.log(z * math.sqrt(2 * math.pi))).otherwise(-F.log(_normal(z)))


def battery(token: Column) -> Column:
    """Encoding and test values of a token with letters and digits: (encoding, chi, runs, serial, p, evidence).

    chi, runs, serial: standardised values, near 0 for uniform random characters. p: of the three together
    (Bonferroni, two-sided). evidence: -log10 of the probability, divided by the weight of the length, that an
    ordinary identifier of the length and encoding is as far from ordinary letter frequencies (chi-squared in its
    likelihood-ratio form, two degrees of freedom), runs of one class and alternation of vowels and consonants; the
    three by Fisher's method. Hexadecimal digits are too few letters for the last one, so that they have two.
    """
    body = F.regexp_replace(token, "=+$", "")
    encoding, alphabet = F.lit("mixed"), F.lit(CAPITALS + SMALL + DIGITS + "+/-_")
    for name, pattern, letters in reversed(ENCODINGS):
        encoding = F.when(token.rlike(pattern), name).otherwise(encoding)
        alphabet = F.when(token.rlike(pattern), F.lit(letters)).otherwise(alphabet)

    def counts(text: Column, groups: tuple) -> Column:
        """(o, share) of each group of letters."""
        each = [F.length(F.regexp_replace(text, f"[^{g}{g.upper()}]", "")).cast("double").alias("o") for g in groups[0]]
        return F.array(*[F.struct(o, F.lit(share).alias("share")) for o, share in zip(each, groups[1])])

    def values(start: Column) -> Column:
        chars, letters = start["chars"], start["alphabet"]
        return F.struct(
            F.transform(chars, lambda c: F.instr(letters, c)).alias("v"),
            F.length(letters).cast("double").alias("k"),
            chars.alias("chars"),
            F.transform(chars, lambda c: F.when(c.rlike("[aeiouAEIOU]"), 1).when(c.rlike("[A-Za-z]"), 2).otherwise(0)).alias("sounds"),
            start["hex"].alias("hex"),
            F.when(start["hex"], counts(start["body"], HEX_GROUPS)).otherwise(counts(start["body"], LETTER_GROUPS)).alias("groups"),
        )

    def tests(x: Column) -> Column:
        v, k = x["v"], x["k"]
        n = F.size(v).cast("double")
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, y: s + y)
        # Chi-squared: squared counts of the distinct characters.
        squares = F.transform(
            F.array_distinct(v), lambda c: F.pow(F.size(F.filter(v, lambda y: y == c)).cast("double"), F.lit(2.0))
        )
        chi = (total(squares) * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        # Runs above and below the middle of the alphabet.
        after = F.slice(v, 2, F.size(v))
        before = F.slice(v, 1, F.size(v) - 1)
        high = total(F.transform(v, lambda y: F.when(2 * y > k, 1.0).otherwise(0.0)))
        turns = total(F.zip_with(before, after, lambda a, b: F.when((2 * a > k) != (2 * b > k), 1.0).otherwise(0.0)))
        both = 2 * high * (n - high)
        spread = F.sqrt(both * (both - n) / (n * n * (n - 1)))
        runs = F.when(both > n, (turns - both / n) / spread).otherwise(F.lit(-9.0))
        # Serial correlation of neighbours.
        mean = total(F.transform(v, lambda y: y.cast("double"))) / n
        variance = total(F.transform(v, lambda y: (y - mean) * (y - mean)))
        product = total(F.zip_with(before, after, lambda a, b: (a - mean) * (b - mean)))
        serial = F.when(variance > 0, (product / variance + 1 / n) * F.sqrt(n)).otherwise(F.lit(9.0))
        # Changes of class between neighbours.
        kind = lambda c: F.when(c.between("0", "9"), 0).when(c.between("a", "z"), 1).when(c.between("A", "Z"), 2).otherwise(3)
        chars = x["chars"]
        switches = total(
            F.zip_with(
                F.slice(chars, 1, F.size(chars) - 1),
                F.slice(chars, 2, F.size(chars)),
                lambda a, b: F.when(kind(a) != kind(b), 1.0).otherwise(0.0),
            )
        )
        q = ORDINARY_SWITCHES
        mixed = _surprise((switches - 0.5 - q * (n - 1)) / F.sqrt(q * (1 - q) * (n - 1)))
        # Letters against ordinary frequencies; only more rare ones than ordinary speak for a secret.
        groups = x["groups"]
        m = F.aggregate(groups, F.lit(0.0), lambda s, g: s + g["o"])
        ratio = total(F.transform(groups, lambda g: F.when(g["o"] > 0, g["o"] * F.log(g["o"] / (m * g["share"]))).otherwise(0.0)))
        rare = F.when(groups[2]["o"] > m * groups[2]["share"], F.greatest(ratio, F.lit(0.0))).otherwise(0.0)
        # Alternation of vowels and consonants among neighbouring letters.
        first, second = F.slice(x["sounds"], 1, F.size(v) - 1), F.slice(x["sounds"], 2, F.size(v))
        pairs = total(F.zip_with(first, second, lambda a, b: F.when(a * b > 0, 1.0).otherwise(0.0)))
        alternate = total(F.zip_with(first, second, lambda a, b: F.when(a * b == 2, 1.0).otherwise(0.0)))
        r = ORDINARY_TURNS
        stiff = F.when(pairs > 0, _surprise((r * pairs - 0.5 - alternate) / F.sqrt(r * (1 - r) * pairs))).otherwise(0.0)
        joint = let(
            F.struct(F.when(x["hex"], rare + mixed).otherwise(rare + mixed + stiff).alias("s"), x["hex"].alias("hex")),
            lambda y: y["s"] - F.log(1 + y["s"] + F.when(y["hex"], 0.0).otherwise(y["s"] * y["s"] / 2)),
        )
        worst = F.greatest(F.abs(chi), F.abs(runs), F.abs(serial))
        return F.struct(
            chi.alias("chi"),
            runs.alias("runs"),
            serial.alias("serial"),
            F.least(F.lit(1.0), 6 * _normal(worst)).alias("p"),
            (joint / math.log(10) + F.log10(n / WEIGHT_LENGTH)).alias("evidence"),
        )

    start = F.struct(
        F.array_remove(F.split(body, ""), "").alias("chars"),
        alphabet.alias("alphabet"),
        body.alias("body"),
        encoding.isin("hex", "HEX").alias("hex"),
    )
    return F.struct(encoding.alias("encoding"), let(let(start, values), tests).alias("tests"))


def _overlaps(spans: Column, start: Column, end: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < end) & (start < s["end"]))


def candidates(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """row (the carried columns of docs, by default all), base (start, rank, end, kind), candidates (start, end, value, test): one pass over the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    carried = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)])
    rows = docs.select(carried.alias("row"), text.alias("text"))
    assign = F.filter(_found(F.col("text"), ASSIGN, 2), lambda s: F.length(s["value"]) >= 6)
    kinds = [("assign", assign), ("access", _found(F.col("text"), ACCESS)), ("hex", _found(F.col("text"), HEX))]

    def marked(rank: int, kind: str, found: Column) -> Column:
        one = lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")
        )
        return F.transform(found, one)

    base = F.sort_array(F.concat(*[marked(rank, kind, found) for rank, (kind, found) in enumerate(kinds)]))
    rows = rows.select("row", base.alias("base"), _found(F.col("text"), CANDIDATE).alias("runs"))
    open_ = F.filter(
        "runs",
        lambda s: s["value"].rlike("[0-9]")
        & s["value"].rlike("[A-Za-z]")
        & ~_overlaps(F.col("base"), s["start"], s["end"]),
    )
    tested = F.transform(
        open_, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), battery(s["value"]).alias("test"))
    )
    return rows.select("row", "base", tested.alias("candidates"))


def discovery_limit(found: DataFrame, false_discoveries: float = FALSE_DISCOVERIES) -> float:
    """The least evidence of a discovery: weighted Benjamini-Hochberg over all candidates.

    Those that do not pass as random are never discoveries and count with no evidence. Candidates are counted by
    evidence in at most LAST_BIN + 1 bins; each counts with its bin's lower edge.
    """
    ranked = lambda t: F.when(t["p"] >= UNIFORMITY_LEVEL, t["evidence"]).otherwise(0.0)
    evidence = F.explode(F.transform("candidates", lambda c: F.struct(ranked(c["test"]["tests"]).alias("e"))))
    bins = (
        found.select(evidence.alias("c"))
        .select(F.least(F.lit(LAST_BIN), F.greatest(F.lit(0), F.floor(F.col("c.e") / BIN))).alias("bin"))
        .groupBy("bin")
        .count()
        .collect()
    )
    counts = {int(r["bin"]): r["count"] for r in bins if r["bin"] is not None}
    total, so_far, limit = sum(counts.values()), 0, math.inf
    for b in sorted(counts, reverse=True):
        so_far += counts[b]
        if 10 ** (-b * BIN) <= false_discoveries * so_far / total:
            limit = b * BIN
    return limit


def scan_secrets(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (by default all) as struct row, base and spans: arrays of (start, rank, end, kind), by start.

    A span of the battery has the kind "random"; it never overlaps a base span. A null text is an empty one and
    has no spans. Repeated rows are scanned each; an empty table gives an empty result.
    """
    found = written(candidates(docs, text_col, carry))
    limit = discovery_limit(found)
    passes = lambda t: (t["p"] >= UNIFORMITY_LEVEL) & (t["evidence"] >= limit)
    more = F.transform(
        F.filter("candidates", lambda c: passes(c["test"]["tests"])),
        lambda c: F.struct(
            c["start"].alias("start"), F.lit(3).alias("rank"), c["end"].alias("end"), F.lit("random").alias("kind")
        ),
    )
    spans = F.sort_array(F.concat("base", more)) if math.isfinite(limit) else F.col("base")
    return found.select("row", "base", spans.alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random: one row per input row."""
    count = lambda spans, kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return scan_secrets(rows, "text", ["doc_id"]).select(
        F.col("row.doc_id").alias("doc_id"),
        count("base", "assign").alias("n_assign"),
        count("base", "access").alias("n_access"),
        count("base", "hex").alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        count("spans", "random").alias("n_random"),
    )


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with each span (overlapping ones as one) replaced by mark; all columns and rows stay."""
    text = F.col(f"row.{text_col}")
    # "at" is the end of what is copied or covered so far; a span that begins before it only extends the cover.
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        piece = F.array(F.concat(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark)))
        out = F.when(x["start"] < s["at"], s["out"]).otherwise(F.concat(s["out"], piece))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), out.alias("out"))

    def finish(s: Column) -> Column:
        return F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text)))

    cleaned = F.when(F.size("spans") == 0, text).otherwise(F.aggregate("spans", state, step, finish))
    columns = [cleaned.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return scan_secrets(docs, text_col).select(*columns)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))
