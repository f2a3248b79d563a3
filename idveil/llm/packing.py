"""Best-fit packing with several capacities: tokens, documents and attention cost of a sequence.

Pieces of equal length are interchangeable, so the plan is made on the counts of lengths: one number per length,
whatever the size of the corpus. Vector best-fit runs on that histogram with groups of like sequences instead of
single ones; each decision ("pieces so-and-so of length L go to sequences so-and-so, at this offset") is one line
of a table that grows with the number of lengths only. Pieces find their line by their rank among the pieces
of their length, which two small shuffles of ids and lengths give. No text and no ids are shuffled.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from idveil.llm.common import pair, table, written

SEQUENCE_TOKENS = 2048
END_ID = 0
#: Chunks in each of the two generations whose ids a worker remembers.
REMEMBERED = 400_000
#: Words that the tokenizer is given as one text.
LINE = 100
#: Rows of a length that are numbered together.
RANK_BLOCK = 10_000


@dataclass(frozen=True)
class Capacities:
    """What one sequence holds at most. Attention cost of a piece: its length squared.

    weights: of tokens, documents and attention cost in the choice of a sequence; rule: "norm" takes the sequence
    with the least weighted norm of what stays free, "dot" the one with the largest weighted dot-product of
    what is free and what the piece needs.
    """

    tokens: int = SEQUENCE_TOKENS
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"

    def vector(self) -> np.ndarray:
        documents = self.tokens if self.documents is None else self.documents
        attention = self.tokens**2 if self.attention is None else self.attention
        return np.array([self.tokens, documents, attention], np.int64)


def plan_slots(counts: dict[int, int], capacities: Capacities) -> pd.DataFrame:
    """Slots: pieces first_rank, first_rank + 1, ... (pieces in number) of a length go to the sequences first_sequence,
    first_sequence + 1, ..., each at the offset.

    Longest first. A group of sequences with like contents takes one piece each while pieces of the length last;
    the group is split where they end. A piece longer than a sequence, or above the attention capacity, is an error.
    """
    whole = capacities.vector()
    weights = np.array(capacities.weights)
    free = np.zeros((0, 3), np.int64)  # of each group of like sequences
    first, many = np.zeros(0, np.int64), np.zeros(0, np.int64)
    slots, next_sequence = [], 0
    for length in sorted(counts, reverse=True):
        need = np.array([length, 1, length * length], np.int64)
        if (need > whole).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities of a sequence")
        left, rank = counts[length], 0
        while left:
            fits = np.flatnonzero((free >= need).all(axis=1))
            if not len(fits):
                per = int((whole // need).min())
                groups = [(left // per, per), (1, left % per)]
                for sequences, pieces in groups:
                    if not sequences or not pieces:
                        continue
                    for i in range(pieces):
                        slots.append((length, rank, sequences, next_sequence, i * length))
                        rank += sequences
                    free = np.vstack([free, whole - pieces * need])
                    first, many = np.append(first, next_sequence), np.append(many, sequences)
                    next_sequence += sequences
                left = 0
                continue
            if capacities.rule == "norm":
                rest = (free[fits] - need) / whole
                at = fits[np.argmin((weights * rest * rest).sum(axis=1))]
            else:
                at = fits[np.argmax((weights * (free[fits] / whole) * (need / whole)).sum(axis=1))]
            taken = min(left, int(many[at]))
            slots.append((length, rank, taken, int(first[at]), int(whole[0] - free[at, 0])))
            rank, left = rank + taken, left - taken
            if taken < many[at]:
                free = np.vstack([free, free[at]])
                first, many = np.append(first, first[at] + taken), np.append(many, many[at] - taken)
            free[at] -= need
            many[at] = taken
        open_ = (free[:, 0] > 0) & (free[:, 1] > 0)  # full sequences leave
        free, first, many = free[open_], first[open_], many[open_]
    return pd.DataFrame(slots, columns=["length", "first_rank", "pieces", "first_sequence", "offset"], dtype="int64")


_TOKENIZERS: dict[str, list] = {}  # tokenizer, ids by chunk: of the present generation, of the one before
_ENDS: dict[str, np.ndarray | None] = {}  # which ids end a word


def _word_ends(path: str, tokenizer) -> np.ndarray | None:
    """Which ids end a word, where the tokenizer marks that and spells every byte; else None."""
    if path not in _ENDS:
        mark = getattr(tokenizer.model, "end_of_word_suffix", None)
        ids = tokenizer.get_vocab(with_added_tokens=False)
        ends = {t: i for t, i in ids.items() if mark and t.endswith(mark)}
        _ENDS[path] = None
        if sum(len(t) == 1 + len(mark) for t in ends) >= 256:
            _ENDS[path] = np.zeros(1 + max(tokenizer.get_vocab().values()), bool)
            _ENDS[path][list(ends.values())] = True
    return _ENDS[path]


def _line_ids(path: str, tokenizer, words: list[bytes]) -> tuple[dict[bytes, bytes], list[bytes]]:
    """The ids of words of letters, which the tokenizer is given many at a time, and the words that are to be encoded alone.

    A word of letters has one end or more among its ids. A text with as many ends as words has one end in each.
    """
    ends = _word_ends(path, tokenizer)
    if ends is None:
        return {}, words
    out, alone = {}, []
    lines = [words[at : at + LINE] for at in range(0, len(words), LINE)]
    found = tokenizer.encode_batch_fast([b" ".join(x).decode() for x in lines], add_special_tokens=False)
    for line, encoded in zip(lines, found):
        ids = np.array(encoded.ids, "<u4")
        stops = (4 * (np.flatnonzero(ends[ids]) + 1)).tolist()
        if len(stops) != len(line):
            alone += line
            continue
        raw = ids.tobytes()
        out.update((w, raw[a:b]) for w, a, b in zip(line, [0, *stops], stops))
    return out, alone


def _chunk_ids(path: str, chunks: set[bytes]) -> dict[bytes, bytes]:
    """The ids of each chunk as little-endian 32-bit numbers. A chunk has no white space.

    A full generation becomes the one before; chunks that are met again move on, so frequent ones are never forgotten.
    """
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = [Tokenizer.from_file(path), {}, {}]
    tokenizer, young, old = _TOKENIZERS[path]
    if len(young) > REMEMBERED:
        young, old = {}, young
        _TOKENIZERS[path][1:] = [young, old]
    missing = []
    for c in chunks:
        if c not in young:
            if c in old:
                young[c] = old[c]
            else:
                missing.append(c)
    words, missing = _parted(missing)
    for at in range(0, len(words), 20_000):
        found, alone = _line_ids(path, tokenizer, words[at : at + 20_000])
        young.update(found)
        missing += alone
    for at in range(0, len(missing), 20_000):
        part = missing[at : at + 20_000]
        found = tokenizer.encode_batch_fast([c.decode() for c in part], add_special_tokens=False)
        for chunk, encoded in zip(part, found):
            young[chunk] = np.array(encoded.ids, "<u4").tobytes()
    return young


def _parted(chunks: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Chunks of letters alone, and the others."""
    words, others = [], []
    for c in chunks:
        (words if c.decode().isalpha() else others).append(c)
    return words, others


#: Signs that end a chunk after a letter: the tokenizer parts them from the word before merging.
_SIGNS = re.compile(
    rb"[!-/:-@\[-`{-~](?:(?<=[a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))[!-/:-@\[-`{-~]*+(?![^\x20\x09-\x0D])"
)


def _chunks(text: str) -> list[bytes]:
    """The white-space-free chunks of a text, signs at their ends apart from words. The tokenizer lower-cases and drops white space, and
    merges within runs of letters or of other signs, so the ids of a text are those of its chunks in order. Special
    tokens are told by case, so a text that may hold one keeps its case."""
    raw = text.encode()
    return (raw if b"<|" in raw else _SIGNS.sub(rb" \g<0>", raw.lower())).split()


def tokenise(
    docs: DataFrame,
    tokenizer_path: str,
    tokens: int = SEQUENCE_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of documents: doc_id, piece, start, length, ids_crc32, and with with_ids the ids.

    A document is the ids of its text (null: empty) and END_ID, so it has one piece at least; only longer ones than
    a sequence are cut. The tokenizer must drop white space and lower-case, as word_bpe_49k does.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end = np.array([END_ID], "<u4").tobytes()
        for frame in frames:
            rows = []
            for at in range(0, len(frame), 500):
                part = frame[at : at + 500]
                texts = [_chunks(t) for t in part["text"]]
                known = _chunk_ids(tokenizer_path, set().union(*texts))
                for doc_id, chunks in zip(part["doc_id"], texts):
                    ids = b"".join(map(known.__getitem__, chunks)) + end
                    for piece, start in enumerate(range(0, len(ids), 4 * tokens)):
                        own = ids[start : start + 4 * tokens]
                        row = (doc_id, piece, start // 4, len(own) // 4, zlib.crc32(own))
                        rows.append((*row, np.frombuffer(own, "<u4").astype(np.int32)) if with_ids else row)
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            yield pd.DataFrame(rows, columns=names)

    rows = pair(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    )


def pack(pieces: DataFrame, capacities: Capacities = Capacities()) -> DataFrame:
    """pieces with sequence_id and offset: as few sequences as vector best-fit needs, gapless from offset 0.

    pieces has doc_id, piece and length, and is read twice, so it should be a written table; its other columns stay, but
    must not be named sequence_id or offset (an error). Repeated rows are packed each. An empty table gives an empty
    result.
    """
    clash = {"sequence_id", "offset"} & set(pieces.columns)
    if clash:
        raise ValueError(f"pieces already has {', '.join(sorted(clash))}")
    unused = "_" * max(2, 1 + max(len(c) - len(c.lstrip("_")) for c in pieces.columns))
    block_, number_, before_, rank_ = (f"{unused}{x}" for x in ("block", "n", "before", "rank"))
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = plan_slots(counts, capacities)
    shift = 44
    keys = (slots["length"].to_numpy() << shift) + slots["first_rank"].to_numpy()
    order = np.argsort(keys)
    plan = spark.sparkContext.broadcast(
        (keys[order], slots["first_sequence"].to_numpy()[order], slots["offset"].to_numpy()[order])
    )

    blocks = 1 + sum(counts.values()) // RANK_BLOCK
    block = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks))
    within = Window.partitionBy("length", block_).orderBy("doc_id", "piece")
    before = Window.partitionBy("length").orderBy(block_).rowsBetween(Window.unboundedPreceding, -1)
    rows = pieces.withColumn(block_, block)
    offsets = (
        rows.groupBy("length", block_)
        .agg(F.count(F.lit(1)).alias(number_))
        .select("length", block_, F.coalesce(F.sum(number_).over(before), F.lit(0)).alias(before_))
    )
    ranked = (
        rows.withColumn(rank_, F.row_number().over(within) - 1)
        .join(offsets, ["length", block_])
        .withColumn(rank_, F.col(rank_) + F.col(before_))
        .select(*[F.col(f"`{c}`") for c in pieces.columns], rank_)
    )

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, sequence, offset = plan.value
        for f in frames:
            key = (f["length"].to_numpy() << shift) + f[rank_].to_numpy()
            at = np.searchsorted(keys, key, side="right") - 1
            yield f.drop(columns=rank_).assign(sequence_id=sequence[at] + key - keys[at], offset=offset[at])

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in pieces.schema)
    return ranked.mapInPandas(assign, f"{fields}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacities: Capacities = Capacities(),
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Tokenised, cut and packed: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    Null texts are empty: one piece of one token. A null id, and rows that repeat one, are documents of their own. Whole
    texts of any length; other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    return pack(written(tokenise(docs, tokenizer_path, capacities.tokens, id_col, text_col, with_ids)), capacities)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (all ids of a sequence), doc_ids (by offset), of a packing with ids."""
    members = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(members.alias("m")).select(
        "sequence_id", F.flatten("m.ids").alias("ids"), F.col("m.doc_id").alias("doc_ids")
    )


def op6_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path)
