"""Conversation prefix trie: union-find over the longest common prefixes of sorted neighbours, in descending depth.

Conversations are rows of turn digests, sorted and dealt out by range, so that those with a common prefix are
neighbours. In a block of neighbours, the edges (i, i + 1), of the depth of their common prefix, are taken from the
deepest to the shallowest; each that joins two components makes a branching node, or widens the node of that depth.
Nodes with one child lie on the edges between branching nodes and are written out from those.

Only the nodes on the paths of a block's first and last conversation can go on in another block. All others are
complete and leave as rows. What hangs from an open path is added up in its nodes, so a block contracts to two
paths; those of neighbouring blocks are merged by the same union-find, first in a task, then in groups of tasks, until
one is left. A node's conversations, copies of one conversation among them, thus never meet in one task.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idveil.llm.common import table, words, written

#: Conversations of one family begin alike: id minus its remainder, by at most so many turns less one.
FAMILY, HEADS = 20, 4
#: Neighbouring tasks whose open paths are merged in one group.
FAN_IN = 16
#: Rows that may be broadcast.
MAX_BROADCAST = 200_000
#: Bytes of a turn's digest.
WIDTH = 16

_ROWS = (
    "kind int, conv_id long, depth long, parent_conv_id long, parent_key binary, key binary, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, ids string, place long, summary binary"
)
_NODE, _ENDS, _OPEN = 0, 1, 2


@dataclass
class Path:
    """A conversation: its digests, words in turns before each depth, and what hangs from it by depth.

    hung: depth -> [conversations, least id, children, leaves, saved tokens], of what is complete, apart from the path's own nodes.
    ids: ids of those that end where the path ends, in order, as text; None on a path that blocks before contracted to,
    whose ids have left already, and whose nodes others refer to by their keys.
    """

    digests: bytes
    before: np.ndarray
    hung: dict[int, list] = field(default_factory=dict)
    ids: str | None = None

    def __len__(self) -> int:
        return len(self.before) - 1


def common_depths(paths: list[Path]) -> np.ndarray:
    """Turns that each path has in common with the next, from its first."""
    if len(paths) < 2:
        return np.zeros(0, np.int64)
    flat = np.frombuffer(b"".join(p.digests for p in paths), "<u8").reshape(-1, WIDTH // 8)
    sizes = np.array([len(p) for p in paths])
    starts = np.cumsum(sizes) - sizes
    shorter = np.minimum(sizes[:-1], sizes[1:])
    owner = np.repeat(np.arange(len(shorter)), shorter)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(shorter) - shorter, shorter)
    differ = (flat[starts[owner] + within] != flat[starts[owner + 1] + within]).any(axis=1)
    out = shorter.copy()
    np.minimum.at(out, owner[differ], within[differ])
    return out


class Forest:
    """The nodes over neighbouring paths at which something hangs or branches."""

    def __init__(self, paths: list[Path]):
        self.paths = paths
        self.depth: list[int] = []
        self.path: list[int] = []  # a path through the node
        self.parent: list[int] = []
        self.hung: list[list] = []
        self.ends: list[list[int]] = []  # paths that end at the node
        self.carried: list[bool] = []  # whether blocks before left it open
        self._component = list(range(len(paths)))
        self._top = [-1] * len(paths)
        edges = common_depths(paths)
        events = [(-d, 0, i) for i, p in enumerate(paths) for d in p.hung]
        events += [(0, 0, 0)] if 0 not in paths[0].hung else []  # the root
        events += [(-int(d), 1, i) for i, d in enumerate(edges)]
        for minus, kind, i in sorted(events):
            if kind == 0:
                self._hang(i, -minus)
            else:
                self._join(i, i + 1, -minus)

    def _find(self, i: int) -> int:
        component = self._component
        while component[i] != i:
            component[i] = component[component[i]]
            i = component[i]
        return i

    def _at(self, component: int, path: int, depth: int) -> int:
        """The component's top node if it has this depth, else a new one above it."""
        top = self._top[component]
        if top >= 0 and self.depth[top] == depth:
            return top
        node = len(self.depth)
        self.depth.append(depth)
        self.path.append(path)
        self.parent.append(-1)
        self.hung.append([0, None, 0, 0, 0])
        self.ends.append([])
        self.carried.append(False)
        if top >= 0:
            self.parent[top] = node
        self._top[component] = node
        return node

    def _hang(self, i: int, depth: int) -> None:
        node, path = self._at(self._find(i), i, depth), self.paths[i]
        if depth in path.hung:
            add(self.hung[node], path.hung[depth])
            self.carried[node] |= path.ids is None
        if depth == len(path):
            self.ends[node].append(i)

    def _join(self, i: int, j: int, depth: int) -> None:
        a, b = self._find(i), self._find(j)
        node = self._at(a, i, depth)
        other = self._top[b]
        if self.depth[other] == depth:  # the same node, met from both sides
            add(self.hung[node], self.hung[other])
            self.ends[node] += self.ends[other]
            self.carried[node] |= self.carried[other]
            self.depth[other] = -1  # no node any more; its children find their parent through it
        self.parent[other] = node
        self._component[b] = a
        self._top[a] = node

    def above(self, node: int) -> int:
        """The parent of a node, -1 for the root."""
        up = self.parent[node]
        while up >= 0 and self.depth[up] < 0:
            up = self.parent[up]
        return up


def add(to: list, more: list) -> None:
    for k in (0, 2, 3, 4):
        to[k] += more[k]
    if more[1] is not None and (to[1] is None or more[1] < to[1]):
        to[1] = more[1]


class Rows:
    """Rows of the result, collected column by column."""

    def __init__(self):
        self.found: dict[str, list] = {c.split()[0]: [] for c in _ROWS.split(", ")}

    def put(self, **values) -> None:
        for name, column in self.found.items():
            column.append(values.get(name))

    def frame(self) -> pd.DataFrame:
        out = pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in self.found.items()})
        self.__init__()
        return out


def _digests_at(path: Path, depths: list[int]) -> dict[int, bytes]:
    """Hash of the path's first turns, for some depths."""
    out, h, at = {}, hashlib.md5(), 0
    for d in sorted(set(depths)):
        h.update(path.digests[WIDTH * at : WIDTH * d])
        out[d], at = h.copy().digest(), d
    return out


def _sha(parts) -> str:
    h = hashlib.sha256()
    for k, part in enumerate(parts):
        h.update(f",{part}".encode() if k else part.encode())
    return h.hexdigest()


def grow(paths: list[Path], rows: Rows, last: bool = False) -> list[Path]:
    """Writes the complete nodes of neighbouring paths to rows; returns the first and the last path, with all the rest.

    last: the paths are all there are, so every node is complete.
    """
    forest = Forest(paths)
    nodes = [i for i, d in enumerate(forest.depth) if d >= 0]
    nodes.sort(key=lambda i: -forest.depth[i])
    above = {i: forest.above(i) for i in nodes}
    end_of = {i: node for node in nodes for i in forest.ends[node]}
    kept = [paths[0]] if len(paths) == 1 or paths[0].digests == paths[-1].digests else [paths[0], paths[-1]]
    open_: dict[int, tuple[int, int]] = {}  # node -> which of the kept paths, depth
    if not last:
        for k, i in reversed([(0, 0), (1, len(paths) - 1)][: len(kept)]):
            node = end_of[i]
            while node >= 0:
                open_[node] = (k, forest.depth[node])
                node = above[node]
    keys: dict[int, bytes] = {}
    for k, path in enumerate(kept if not last else []):
        depths = {node: d for node, (which, d) in open_.items() if which == k}
        found = _digests_at(path, list(depths.values()))
        keys |= {node: found[d] for node, d in depths.items()}

    below: dict[int, list] = {i: list(forest.hung[i]) for i in nodes}
    least: dict[int, int] = {}
    for i in nodes:  # from the deepest
        if i in open_:
            continue
        n, least[i], children, leaves, saved = below[i]
        if not children:
            leaves = below[i][3] = 1
        if above[i] >= 0:
            depth, top = forest.depth[i], forest.depth[above[i]]
            before = paths[forest.path[i]].before
            saved += (n - 1) * int(before[depth] - before[top])
            add(below[above[i]], [n, least[i], 1, leaves, saved])

    for i in nodes:
        ends = sorted(p for p in forest.ends[i] if paths[p].ids is not None)
        carried = forest.carried[i] or i in open_
        if carried:
            key = keys.get(i) or _digests_at(paths[forest.path[i]], [forest.depth[i]])[forest.depth[i]]
            for p in ends:
                rows.put(kind=_ENDS, key=key, place=int(paths[p].ids.split(",", 1)[0]), ids=paths[p].ids)
        if i in open_:
            continue
        n, _, children, leaves, saved = below[i]
        before, depth, up = paths[forest.path[i]].before, forest.depth[i], above[i]
        top = forest.depth[up] if up >= 0 else -1
        shared = {"kind": _NODE, "conv_id": least[i], "n_convs": n, "n_leaves": leaves}
        for d in range(depth, top, -1):  # the node, and those with one child above it
            more = {"key": key} if carried else {"ends_sha256": _sha(paths[p].ids for p in ends) if ends else None}
            own = more | {"n_children": children} if d == depth else {"n_children": 1}
            if d > top + 1:
                own["parent_conv_id"] = least[i]
            elif up in open_:
                own["parent_key"] = keys[up]
            elif up >= 0:
                own["parent_conv_id"] = least[up]
            spared = saved + (n - 1) * int(before[depth] - before[d - 1]) if d else saved
            rows.put(depth=d, saved_tokens=spared, **shared, **own)

    if last:
        return []
    for p in kept:
        p.hung, p.ids = {}, None
    for node, (k, depth) in open_.items():
        hung = kept[k].hung.setdefault(depth, [0, None, 0, 0, 0])
        add(hung, below[node])
    return kept


def _paths(f: pd.DataFrame) -> list[Path]:
    """The distinct conversations of a block of sorted rows (conv_id, digests, words)."""
    keys, ids = f["digests"].tolist(), f["conv_id"].tolist()
    starts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
    out = []
    for a, b in zip(starts, [*starts[1:], len(keys)]):
        before = np.concatenate([[0], np.cumsum(f["words"].iloc[a], dtype=np.int64)])
        out.append(Path(keys[a], before, {len(before) - 1: [b - a, ids[a], 0, 0, 0]}, ",".join(map(str, ids[a:b]))))
    return out


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The complete nodes of a sorted partition, block by block, and its open paths under the partition's number."""
    from pyspark import TaskContext

    rows, held = Rows(), []
    for f in frames:
        if len(f):
            held = grow(held + _paths(f), rows)
            yield rows.frame()
    if held:
        rows.put(kind=_OPEN, place=TaskContext.get().partitionId(), summary=pickle.dumps(held))
        yield rows.frame()


def _merged(open_rows: DataFrame, last: bool) -> DataFrame:
    """The same for FAN_IN neighbours' open paths at a time."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f, rows = f.sort_values("place"), Rows()
        paths = [p for summary in f["summary"] for p in pickle.loads(summary)]
        kept = grow(paths, rows, last)
        if kept:
            rows.put(kind=_OPEN, place=int(f["place"].iloc[0]) // FAN_IN, summary=pickle.dumps(kept))
        return rows.frame()

    group = F.lit(0) if last else F.floor(F.col("place") / FAN_IN)
    return open_rows.select("place", "summary").groupBy(group.alias("group")).applyInPandas(run, _ROWS)


def _joined_ids(ends: DataFrame) -> DataFrame:
    """key, sha: SHA-256 of each key's ids in order. Pieces stream through; one hash is held."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, h = None, None
        for f in frames:
            done = []
            for k, ids in zip(f["key"], f["ids"]):
                if k != key:
                    if key is not None:
                        done.append((key, h.hexdigest()))
                    key, h = k, hashlib.sha256(ids.encode())
                else:
                    h.update(f",{ids}".encode())
            yield pd.DataFrame(done, columns=["key", "sha"])
        if key is not None:
            yield pd.DataFrame([(key, h.hexdigest())], columns=["key", "sha"])

    dealt = ends.select("key", "place", "ids").repartition("key").sortWithinPartitions("key", "place")
    return dealt.mapInPandas(run, "key binary, sha string")


def _few(rows: DataFrame) -> DataFrame:
    """rows for a broadcast if there are few of them; else as they are, and AQE splits the hot keys of the other side."""
    return F.broadcast(rows) if rows.count() <= MAX_BROADCAST else rows


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie over conversations (conv_id long, distinct; digests: WIDTH bytes per turn; words: of each turn).

    Columns as of prefix_trie. A conversation's digests are one row; a node's conversations never are.
    """
    dealt = conversations.repartitionByRange("digests", "conv_id").sortWithinPartitions("digests", "conv_id")
    found = written(dealt.select("conv_id", "digests", "words").mapInPandas(_blocks, _ROWS))
    rounds = [found]
    number = found.where(F.col("kind") == _OPEN).count()
    while number:
        found = written(_merged(found.where(F.col("kind") == _OPEN), number <= FAN_IN))
        rounds.append(found)
        number = found.where(F.col("kind") == _OPEN).count()
    everything = rounds[0]
    for more in rounds[1:]:
        everything = everything.unionAll(more)

    nodes = everything.where(F.col("kind") == _NODE)
    carried = nodes.where("key IS NOT NULL").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("least"))
    under = nodes.where("parent_key IS NOT NULL").join(_few(carried), "parent_key").withColumn("parent_conv_id", F.col("least"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    all_nodes = nodes.where("parent_key IS NULL").select(*columns, "key", "ends_sha256")
    all_nodes = all_nodes.unionAll(under.select(*columns, "key", "ends_sha256"))
    shas = written(_joined_ids(everything.where(F.col("kind") == _ENDS)))
    kept = all_nodes.where("key IS NOT NULL").drop("ends_sha256").join(_few(shas), "key", "left")
    no_ends = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        all_nodes.where("key IS NULL")
        .select(*columns, F.coalesce("ends_sha256", no_ends).alias("ends_sha256"))
        .unionAll(kept.select(*columns, F.coalesce("sha", no_ends).alias("ends_sha256")))
    )


def turn_digest(role: Column, text: Column) -> Column:
    """128-bit hash of a turn, as hexadecimal digits; role and text cannot run into each other."""
    return F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, digests, words of the conversations of turns (conv_id, turn, role, text) after the exchange of their beginnings.

    Conversation c takes the first crc32(c) % HEADS turns of conversation c - c % FAMILY (all if fewer, none if there is no
    such one), then its own turns after as many. Texts stay where they are read: a turn is a hash and a number.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct("turn", turn_digest(role, text).alias("digest"), F.size(words(text)).alias("words"))
    conv = F.col("conv_id").cast("long")
    rows = turns.where(conv.isNotNull()).select((conv - conv % FAMILY).alias("family"), conv.alias("conv_id"), turn.alias("turn"))
    # One shuffle: conversations and their families' first ones are in the same task.
    whole = rows.repartition("family").groupBy("family", "conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    heads = whole.where("conv_id = family").select("family", F.slice("turns", 1, HEADS - 1).alias("heads"))
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    head = F.coalesce(F.slice("heads", F.lit(1), taken.cast("int")), F.slice("turns", 1, 0))
    own = F.slice("turns", (taken + 1).cast("int"), F.size("turns"))
    joined = whole.join(heads, "family", "left").select("conv_id", F.concat(head, own).alias("turns"))
    return joined.select(
        "conv_id",
        F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("digests"),
        F.transform("turns", lambda t: t["words"]).alias("words"),
    )


def prefix_trie(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per distinct beginning of the rebuilt conversations: conv_id (least member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first; of equal turns, repeated rows among them, by their digest: each is a turn.
    Null roles and texts are empty. Rows without a conversation are none. Turns are equal when their 128-bit digests are.
    An empty table gives an empty result; other columns are ignored.
    """
    chosen = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    )
    return trie(written(rebuilt(chosen)))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))
