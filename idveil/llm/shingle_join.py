"""N-gram Jaccard join by parity sketches.

Each document's set of word shingles is folded into a bit sketch: every shingle flips one bit, so the Hamming distance
of two sketches never exceeds the size of the sets' symmetric difference. A similarity threshold bounds that
difference by the sizes, so within a band of sizes two linked documents have sketches at most D bits apart: of
D + 1 + S pieces of the sketch, S + 1 at least are equal. Each side leaves out its S pieces with the fewest bits, as equal
pieces have equally many; documents meet in the buckets of equal pieces.

Only distinct sets take part (copies are one representative). In each bucket the representative that shares most
pieces with others is the hub; all others are compared with it, which is linear in the bucket. What the links found so
far already connect needs no comparison; the pairs of a bucket that they do not connect are compared by sketch in
blocks of bounded size, and those whose sketches are near enough are verified on the whole sets. So no link
between different components is lost, and no bucket is expanded into pairs.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idveil.llm.common import pair, table, written

#: Pieces beyond D + 1, and more for each unit of D. As many may be left out of the buckets: light pieces say little.
SPARE, SPARE_SHARE = 2, 0.08
#: Bits of a sketch per shingle, at least: of those that are compared, and of those that are cut into pieces, where many
#: bits make the pieces of different sets differ, also those with one shingle only. The latter are never laid out: only the
#: places of their set bits are made.
BITS_PER_SHINGLE, KEY_BITS_PER_SHINGLE = 4, 4096
#: Folds (halvings) of the sketches that are compared in blocks; about one bit per shingle is left.
COARSE_FOLDS = 2
#: Representatives of a bucket that are compared in one block.
BLOCK = 512
#: Representatives whose ids are broadcast at most (8 bytes each); more are joined by shuffle.
MAX_BROADCAST_IDS = 500_000
#: Bytes of a shingle's fingerprint in the sets that are verified.
FINGERPRINT_BYTES = 6

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes; remembers the hashes of words."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > 500_000:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        codes = np.array([known[w] for w in words], np.uint64)
        n = min(self.width, len(words))
        out = np.full(len(words) - n + 1, np.uint64(n))
        for i in range(n):
            out = _mix(out * _M1 + codes[i : len(codes) - n + 1 + i])
        return np.unique(out)


class Bands:
    """Size bands: linked sets are in the same band or in neighbouring ones."""

    def __init__(self, percent: int):
        self.percent, self.edges = percent, [1]

    def of(self, size: int) -> int:
        while self.edges[-1] <= size:
            self.edges.append(max(self.edges[-1] + 1, self.edges[-1] * 100 // self.percent + 1))
        return int(np.searchsorted(self.edges, size, side="right")) - 1

    def first(self, band: int) -> int:
        while len(self.edges) <= band:
            self.of(self.edges[-1])
        return self.edges[band]

    def distance(self, a: int, b: int) -> int:
        """Largest symmetric difference of linked sets of these sizes."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def bits(self, band: int, per_shingle: int = BITS_PER_SHINGLE) -> int:
        """Bits of the sketches of this band and the next."""
        return max(64, 1 << (per_shingle * (self.first(band + 2) - 1) - 1).bit_length())

    def shape(self, band: int) -> tuple[int, int, int]:
        """Bits and pieces where sets of this band and the next meet, and how many pieces either may leave out."""
        distance = self.distance(self.first(band + 1) - 1, self.first(band + 2) - 1)
        spare = SPARE + int(SPARE_SHARE * distance)
        return self.bits(band, KEY_BITS_PER_SHINGLE), distance + 1 + spare if distance else 0, spare


def _sketch(shingles: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the shingles per bit; folding a sketch in half gives that of half the bits."""
    return (np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)


def _set_bits(shingles: np.ndarray, bits: int) -> np.ndarray:
    """The places of the bits that _sketch sets, in order, however many bits there are."""
    places, times = np.unique(shingles & np.uint64(bits - 1), return_counts=True)
    return places[(times & 1).astype(bool)]


def piece_keys(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    """Bucket keys of a set: its own band, and the one below, where it meets smaller sets."""
    band, keys = bands.of(len(shingles)), []
    for join in (band - 1, band):
        if join < 0:
            continue
        bits, pieces, spare = bands.shape(join)
        if not pieces:  # no two different sets of these sizes are near enough
            continue
        set_bits = _set_bits(shingles, bits)
        piece = (set_bits * np.uint64(pieces) // np.uint64(bits)).astype(np.int64)
        weight = np.bincount(piece, minlength=pieces)
        key = np.zeros(pieces, np.uint64)
        np.bitwise_xor.at(key, piece, _mix(set_bits * _M1 + np.uint64(join)))
        key = _mix(key + _mix(np.arange(pieces, dtype=np.uint64) * _M2 + np.uint64(join)))
        # At least spare + 1 pieces of linked sets are equal, in weight too. Either leaves out at most spare of them, all
        # lighter than those it keeps; so an equal piece is left that has the weight which both keep.
        keys.append(key[weight >= np.partition(weight, spare)[spare]])
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def _profiles(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """doc_id, n, digest (of the set), sketch (bits of the own band), coarse (the sketch folded COARSE_FOLDS times)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle, bands = Shingler(width), Bands(percent)
        for f in frames:
            rows = []
            for doc_id, text in zip(f["doc_id"], f["text"]):
                s = shingle(text)
                sketch = np.packbits(_sketch(s, bands.bits(bands.of(len(s))))).tobytes() if len(s) else b""
                coarse = _fold(sketch, max(64, len(sketch) * 8 >> COARSE_FOLDS)).tobytes() if sketch else b""
                rows.append((doc_id, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), sketch, coarse))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "digest", "sketch", "coarse"])

    return docs.mapInPandas(run, "doc_id long, n long, digest binary, sketch binary, coarse binary")


def _keys(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """key, rep for the sketch pieces of each document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle, bands = Shingler(width), Bands(percent)
        for f in frames:
            for at in range(0, len(f), 1000):
                part = f[at : at + 1000]
                keys = [piece_keys(s, bands) if len(s := shingle(t)) else s for t in part["text"]]
                reps = np.repeat(part["doc_id"].to_numpy(), [len(k) for k in keys])
                yield pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "rep": reps})

    return docs.mapInPandas(run, "key long, rep long")


def _shared_keys(keys: DataFrame) -> DataFrame:
    """The rows of keys (key, rep) whose key two different representatives have, once each.

    Keys are dealt out and sorted once and stream through; only a row and its neighbours are looked at.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, held_kept = np.zeros((0, 2), np.int64), False
        for f in frames:
            if not len(f):
                continue
            rows = np.concatenate([held, f[["key", "rep"]].to_numpy()])
            rows = rows[np.append(True, (rows[1:] != rows[:-1]).any(axis=1))]
            same = rows[1:, 0] == rows[:-1, 0]
            keep = np.append(False, same) | np.append(same, False)
            if len(held):
                keep[0] |= held_kept
            # The last row may have its partner in the next batch.
            yield pd.DataFrame(rows[:-1][keep[:-1]], columns=["key", "rep"])
            held, held_kept = rows[-1:], bool(keep[-1])
        if held_kept:
            yield pd.DataFrame(held, columns=["key", "rep"])

    dealt = keys.repartition("key").sortWithinPartitions("key", "rep")
    return dealt.mapInPandas(run, "key long, rep long")


def _fold(sketch: bytes, bits: int) -> np.ndarray:
    words = np.frombuffer(sketch, np.uint8)
    while len(words) * 8 > bits:
        half = len(words) // 2
        words = words[:half] ^ words[half:]
    return words


def _near(bands: Bands, n: np.ndarray, sketches: list[bytes], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs of rows (by place) can be linked, by their sizes and the distance of their sketches."""
    a, b = np.minimum(n[left], n[right]), np.maximum(n[left], n[right])
    possible = 100 * a >= bands.percent * b
    most = (a + b) * (100 - bands.percent) // (100 + bands.percent)
    sizes = np.array([len(s) for s in sketches])
    bits = 8 * np.minimum(sizes[left], sizes[right])
    out = np.zeros(len(left), bool)
    for size in np.unique(bits[possible]):
        at = np.flatnonzero(possible & (bits == size))
        used = np.unique(np.concatenate([left[at], right[at]]))
        folded = np.stack([_fold(sketches[i], int(size)) for i in used])
        place = np.zeros(len(n), np.int64)
        place[used] = np.arange(len(used))
        for part in np.array_split(at, max(1, len(at) * int(size) // 100_000_000)):
            apart = np.bitwise_count(folded[place[left[part]]] ^ folded[place[right[part]]]).sum(axis=1, dtype=np.int64)
            out[part] = apart <= most[part]
    return out


def _let_go(spark: SparkSession) -> None:
    """Has the driver forget plans that are done, so that Spark deletes their shuffle files now rather than when its memory runs low."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _few(ids: DataFrame) -> DataFrame:
    """ids for a broadcast if there are few of them; else as they are."""
    return F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids


def _sets(docs: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """rep, n, fingerprints of the whole set, for some representatives."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(width)
        for f in frames:
            sets = [shingle(t) for t in f["text"]]
            cut = [s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - FINGERPRINT_BYTES :].tobytes() for s in sets]
            yield pd.DataFrame({"rep": f["doc_id"], "n": [len(s) for s in sets], "prints": cut})

    chosen = docs.join(_few(reps), docs["doc_id"] == reps["rep"], "left_semi").dropDuplicates(["doc_id"])
    return chosen.mapInPandas(run, "rep long, n long, prints binary")


def _verified(docs: DataFrame, pairs: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs (u, v) whose whole sets are similar enough."""
    ids = written(pairs.select(F.explode(F.array("u", "v")).alias("rep")).distinct())
    sets = written(_sets(docs, ids, width))
    left = sets.select(F.col("rep").alias("u"), F.col("n").alias("n_u"), F.col("prints").alias("prints_u"))
    right = sets.select(F.col("rep").alias("v"), F.col("n").alias("n_v"), F.col("prints").alias("prints_v"))

    def values(prints: bytes) -> np.ndarray:
        out = np.zeros((len(prints) // FINGERPRINT_BYTES, 8), np.uint8)
        out[:, :FINGERPRINT_BYTES] = np.frombuffer(prints, np.uint8).reshape(-1, FINGERPRINT_BYTES)
        return out.view("<u8").ravel()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = np.zeros(len(f), bool)
            for i, (a, b) in enumerate(zip(f["prints_u"], f["prints_v"])):
                a, b = values(a), values(b)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(a) + len(b) - both)
            yield f.loc[keep, ["u", "v"]]

    # The many-rows side is split by AQE where a hub is hot; the other side has one row for each set.
    return pairs.join(right, "v").join(left, "u").select("u", "v", "prints_u", "prints_v").mapInPandas(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """id, component (least id reachable) of each id in links (u, v): least labels of neighbours, then labels of labels.

    Each round is written; no list of neighbours is ever gathered.
    """
    both = written(links.select("u", "v").unionAll(links.selectExpr("v AS u", "u AS v")).distinct())
    labels = written(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).selectExpr("id", "least(id, m) AS component"))
    while True:
        least = (
            both.join(labels, both["v"] == labels["id"])
            .groupBy(F.col("u").alias("id"))
            .agg(F.min("component").alias("least"))
        )
        lower = labels.join(least, "id").selectExpr("id", "component AS old", "least(component, least) AS component")
        above = labels.selectExpr("id AS component", "component AS above")
        jumped = written(lower.join(above, "component").selectExpr("id", "old", "least(component, above) AS component"))
        labels = jumped.select("id", "component")
        if not jumped.where("component < old").limit(1).count():
            return labels


def _star_pairs(shared: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """(u, v): each bucket's hub with the others, where their sketches allow a link."""
    sizes = shared.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    score = shared.join(sizes, "key").groupBy("rep").agg(F.sum("size").alias("score"))
    hubs = (
        shared.join(score, "rep")
        .groupBy("key")
        .agg(F.max(F.struct("score", (-F.col("rep")).alias("minus"))).alias("m"))
        .select("key", (-F.col("m.minus")).alias("u"))
    )
    pairs = shared.join(hubs, "key").where("rep <> u").selectExpr("u", "rep AS v").distinct()
    # Most fall to the coarse sketches, which are a quarter of the whole ones to move.
    return _near_pairs(_near_pairs(pairs, profiles, percent, "coarse"), profiles, percent)


def _near_pairs(pairs: DataFrame, profiles: DataFrame, percent: int, sketch: str = "sketch") -> DataFrame:
    """The pairs (u, v) whose sketches allow a link."""
    a = profiles.selectExpr("doc_id AS u", "n AS n_u", f"{sketch} AS sketch_u")
    b = profiles.selectExpr("doc_id AS v", "n AS n_v", f"{sketch} AS sketch_v")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands = Bands(percent)
        for f in frames:
            n = np.concatenate([f["n_u"], f["n_v"]]).astype(np.int64)
            at = np.arange(len(f))
            yield f.loc[_near(bands, n, [*f["sketch_u"], *f["sketch_v"]], at, at + len(f)), ["u", "v"]]

    joined = pairs.join(b, "v").join(a, "u").select("u", "v", "n_u", "sketch_u", "n_v", "sketch_v")
    return joined.mapInPandas(run, "u long, v long")


def _open_pairs(shared: DataFrame, profiles: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(u, v): pairs of a bucket of three or more that no link connects yet, where their sketches allow a link. Compared block by block."""
    rows = shared.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("component")
    )
    size = F.count(F.lit(1)).alias("size")
    mixed = rows.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), size)
    # One of each bucket is the hub, which was compared with all others: two alone have nothing left to compare.
    mixed = mixed.where("a <> b AND size > 2")
    rows = rows.join(mixed.select("key", "size"), "key").join(
        profiles.selectExpr("doc_id AS rep", "n", "coarse AS sketch"), "rep"
    )
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(i, F.col("mine")).alias("i"), F.greatest(i, F.col("mine")).alias("j"))
    )
    rows = rows.withColumn("blocks", blocks).withColumn("mine", mine).withColumn("p", F.explode(others))

    def compared(f: pd.DataFrame, bands: Bands) -> pd.DataFrame:
        """Whole groups, many at once: groups of one size make their pairs together."""
        group = f[["key", "i", "j"]].to_numpy()
        starts = np.flatnonzero(np.append(True, (group[1:] != group[:-1]).any(axis=1)))
        sizes = np.diff(np.append(starts, len(f)))
        rep, part, own = f["rep"].to_numpy(), f["component"].to_numpy(), f["mine"].to_numpy()
        diagonal = (f["i"] == f["j"]).to_numpy()
        u, v, a, b = [], [], [], []
        for size in np.unique(sizes[sizes > 1]):
            first, second = np.triu_indices(size, 1)
            of_size = starts[sizes == size]
            for some in np.array_split(of_size, max(1, len(of_size) * len(first) // 1_000_000)):
                left, right = (some[:, None] + first).ravel(), (some[:, None] + second).ravel()
                wanted = (part[left] != part[right]) & ((own[left] != own[right]) | diagonal[left])
                left, right = left[wanted], right[wanted]
                swap = rep[left] > rep[right]
                left, right = np.where(swap, right, left), np.where(swap, left, right)
                u.append(rep[left]), v.append(rep[right]), a.append(left), b.append(right)
        if not u:
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        pairs = pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v), "a": np.concatenate(a), "b": np.concatenate(b)})
        pairs = pairs.drop_duplicates(["u", "v"])  # a pair may meet in several buckets
        near = _near(bands, f["n"].to_numpy(), list(f["sketch"]), pairs["a"].to_numpy(), pairs["b"].to_numpy())
        return pairs.loc[near, ["u", "v"]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands, held = Bands(percent), None
        for f in frames:
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            # The last group may go on in the next batch; a group has 2 * BLOCK rows or so at most.
            last = (f[["key", "i", "j"]] == f[["key", "i", "j"]].iloc[-1]).all(axis=1).to_numpy()
            held = f[last].reset_index(drop=True)
            if not last.all():
                yield compared(f[~last].reset_index(drop=True), bands)
        if held is not None:
            yield compared(held, bands)

    columns = rows.select("key", "p.i", "p.j", "rep", "component", "n", "sketch", "mine")
    dealt = columns.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return _near_pairs(dealt.mapInPandas(run, "u long, v long").distinct(), profiles, percent)


def near_duplicates(
    docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id, representative_id: one row per input row.

    A document's set is its distinct shingles of width words (ASCII white space parts words, A-Z lower-cased); with
    fewer words, the whole sequence as one. Documents link when 100 * intersection >= percent * union. component_id
    is the least id reachable by links. A document without words, or with a null text or id, links with nothing. Ids are
    integers: others are cast to long, and one that is no number is an error.
    Rows with one id and one text are one document; copies share representative_id, the least id of their set.
    An empty table gives an empty result; other columns are ignored. Sets are compared by 48-bit fingerprints.
    """
    rows = pair(docs, id_col, text_col)
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    profiles = written(_profiles(rows, percent, width))
    classes = written(
        profiles.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    )
    reps = classes.select("rep")
    # Only representatives are cut into pieces, from their texts: the keys are larger than these, so they are dealt out as they
    # are made and never written with the profiles.
    chosen = rows.join(_few(reps), rows["doc_id"] == reps["rep"], "left_semi")
    shared = written(_shared_keys(_keys(chosen, percent, width)))
    _let_go(docs.sparkSession)
    pairs = written(_star_pairs(shared, profiles, percent))
    _let_go(docs.sparkSession)
    links = written(_verified(rows, pairs, percent, width))
    _let_go(docs.sparkSession)
    labels = components(links)
    more = written(_open_pairs(shared, profiles, labels, percent).join(links, ["u", "v"], "left_anti"))
    if more.limit(1).count():
        labels = components(links.unionAll(_verified(rows, more, percent, width)))

    known = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("digest", "rep", F.coalesce("component", "rep").alias("component"))
    linked = F.col("rep").isNotNull() & (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return profiles.select("doc_id", "n", "digest").join(known, "digest", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(linked, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(linked, F.col("rep")).otherwise(F.col("doc_id")).alias("representative_id"),
    )


def keep_one(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near-duplicates, the one with the least id."""
    found = near_duplicates(docs, percent, width, id_col, text_col)
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=90, width=3)

