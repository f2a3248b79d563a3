"""SentencePiece encoding and decoding (BPE with byte fallback) by vectorised merge rounds.

A text is cut where no piece of the model can cross: before each white-space symbol. The distinct words of a
batch are encoded together: one flat array of symbols for all of them, and in each round every word merges all
leftmost occurrences of its lowest-ranked pair at once, until no pair is left. Words are remembered in a
dictionary of bounded size, so a frequent word is encoded about once per worker.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from idveil.llm.common import pair, table

SPACE = "▁"
#: Words that a worker remembers at most; about 200 bytes each.
REMEMBERED = 400_000
_NONE = np.iinfo(np.int64).max


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protobuf message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        else:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class PieceModel:
    """A BPE model file: its pieces, and the table of pairs that merge into a piece."""

    NORMAL, UNKNOWN, BYTE = 1, 2, 6

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        scores, kinds = [], []
        self.dummy_prefix, extra_spaces, normalizer = True, True, ""
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(piece.get(2, 0.0))
                kinds.append(piece.get(3, self.NORMAL))
            elif number == 3:
                spec = dict(_fields(value))
                normalizer = spec.get(1, b"").decode()
                self.dummy_prefix, extra_spaces = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if normalizer != "identity" or extra_spaces:
            raise ValueError("only models that keep the text as it is are supported")
        self.ids = {p: i for i, p in enumerate(self.pieces) if kinds[i] == self.NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has white space after other characters")
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if kinds[i] == self.BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.unknown = kinds.index(self.UNKNOWN)
        self.longest_spaces = max(len(p) for p in self.ids if not p.strip(SPACE)) if SPACE in self.ids else 0
        # Characters without a piece get symbols past the pieces; they never merge.
        self.char_limit = len(self.pieces)
        self.symbol_of = self.char_limit + np.arange(0x110000)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = i
        left, right, rank, made = [], [], [], []
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in self.ids.values()}, reverse=True))}
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(order[scores[i]]), made.append(i)
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        # One entry more, for pairs that are in no piece.
        self.keys = np.append(keys, -1)
        self.rank, self.made = np.append(np.array(rank, np.int64), _NONE), np.append(np.array(made, np.int64), 0)
        self.places = self._places(keys)
        # Long runs of white space: the longest piece is cut off first, again and again; short ones are kept ready.
        most, one = self.longest_spaces, self.ids.get(SPACE)
        self.runs = {n: self.merge(np.full(n, one), np.zeros(n, np.int64))[0].tolist() for n in range(1, 2 * most)}
        if any(self.runs[n][0] != self.ids[SPACE * most] for n in range(most, 2 * most)):
            raise ValueError("runs of white space do not begin with their longest piece")

    @staticmethod
    def _slot(keys: np.ndarray, odd: int, bits: int) -> np.ndarray:
        return ((keys * np.int64(odd)).view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)

    def _places(self, keys: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """Hash tables from keys to their places: what collides in one goes to the next."""
        tables, left = [], np.arange(len(keys))
        for odd in range(0x9E3779B97F4A7C1, 0x9E3779B97F4A7C1 + 400, 2):
            if not len(left):
                break
            bits = max(10, int(np.log2(len(left))) + 4)
            table = np.full(1 << bits, len(keys), np.int32)
            slot = self._slot(keys[left], odd, bits)
            table[slot] = left
            tables.append((odd, bits, table))
            left = left[table[slot] != left]
        return tables

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (_NONE: no piece) and merged symbol of each pair."""
        keys = left << 32 | right
        place = np.full(len(keys), len(self.keys) - 1)
        todo = np.arange(len(keys))
        for odd, bits, table in self.places:
            at = table[self._slot(keys[todo], odd, bits)]
            hit = self.keys[at] == keys[todo]
            place[todo[hit]] = at[hit]
            todo = todo[~hit & (at < len(self.keys) - 1)]  # an empty slot: no later table has the key
            if not len(todo):
                break
        return self.rank[place], self.made[place]

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges the flat symbols of many words, word by word, until no pair is left in any.

        A round merges, in every word that still has a pair, all leftmost occurrences of its best one. That equals
        one merge at a time as long as no merge makes a pair that is as good or better; the words where one
        does merge only their leftmost occurrence in that round. Only pairs beside a merge are looked up again.
        """
        done_symbols, done_words = [symbols[:0]], [word[:0]]
        rank, made = self._next(symbols, word, np.arange(len(symbols)))
        while len(symbols):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lengths = np.diff(np.append(starts, len(symbols)))
            best = np.minimum.reduceat(rank, starts)
            if (best == _NONE).any():  # words without pairs leave the arrays
                open_ = np.repeat(best != _NONE, lengths)
                done_symbols.append(symbols[~open_])
                done_words.append(word[~open_])
                symbols, word, rank, made = symbols[open_], word[open_], rank[open_], made[open_]
                lengths, best = lengths[best != _NONE], best[best != _NONE]
                if not len(symbols):
                    break
            owner = np.repeat(np.arange(len(lengths)), lengths)
            hits = np.flatnonzero(rank == best[owner])
            # Of overlapping occurrences (runs of neighbours that both match) every other one counts.
            new_run = np.append(True, np.diff(hits) > 1)
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(hits)), 0))
            hits = hits[(np.arange(len(hits)) - run_start) % 2 == 0]
            hits = self._without_conflicts(hits, symbols, made, owner, best)
            symbols = symbols.copy()
            symbols[hits] = made[hits]
            keep = np.ones(len(symbols), bool)
            keep[hits + 1] = False
            symbols, word, rank, made = symbols[keep], word[keep], rank[keep], made[keep]
            at = hits - np.arange(len(hits))  # each merge before moved it one to the left
            beside = np.zeros(len(symbols), bool)
            beside[at] = True
            beside[at[at > 0] - 1] = True
            at = np.flatnonzero(beside)
            rank[at], made[at] = self._next(symbols, word, at)
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def _next(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of the pairs that begin at these places."""
        rank, made = np.full(len(at), _NONE), np.zeros(len(at), np.int64)
        inside = at + 1 < len(symbols)
        inside[inside] = word[at[inside] + 1] == word[at[inside]]
        at = at[inside]
        rank[inside], made[inside] = self._pairs(symbols[at], symbols[at + 1])
        return rank, made

    def _without_conflicts(self, hits, symbols, made, owner, best) -> np.ndarray:
        several = np.bincount(owner[hits], minlength=len(best)) > 1
        if not several.any():
            return hits
        after = symbols.copy()
        after[hits] = made[hits]
        keep = np.ones(len(after), bool)
        keep[hits + 1] = False
        after, who = after[keep], owner[keep]
        rank, _ = self._pairs(after[:-1], after[1:])
        # Pairs that were there before and stay are no conflict; only those that touch a merged symbol are new.
        touched = np.zeros(len(symbols), bool)
        touched[hits] = True
        touched = touched[keep]
        new = (who[1:] == who[:-1]) & (touched[1:] | touched[:-1]) & (rank <= best[who[:-1]])
        clash = np.zeros(len(best), bool)
        clash[who[:-1][new]] = True
        # The right neighbour may itself be merged in this round; one at a time it would not have been yet.
        near = hits[hits + 2 < len(symbols)]
        near = near[owner[near + 2] == owner[near]]
        rank, _ = self._pairs(made[near], symbols[near + 2])
        clash[owner[near][rank <= best[owner[near]]]] = True
        clash &= several
        if not clash.any():
            return hits
        first = np.append(True, owner[hits][1:] != owner[hits][:-1])
        return hits[first | ~clash[owner[hits]]]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word. A word is white-space symbols, then other characters (either may be missing)."""
        spaces = [len(w) - len(w.lstrip(SPACE)) for w in words]
        # All spaces but the last merge among themselves; of equal scores the leftmost merges first.
        cores = [w[max(0, n - 1) :] for w, n in zip(words, spaces)]
        chars = "".join(cores)
        lengths = np.fromiter(map(len, cores), np.int64, len(cores))
        codes = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(codes):
            return [self._run(n) if n > 1 else [] for n in spaces]
        flat, word = self.merge(self.symbol_of[codes], np.repeat(np.arange(len(cores)), lengths))
        ends = np.cumsum(np.bincount(word, minlength=len(cores))).tolist()
        odd = set(np.unique(word[flat >= self.char_limit]).tolist())
        flat, space, out, at = flat.tolist(), self.ids.get(SPACE), [], 0
        for i, (n, end) in enumerate(zip(spaces, ends)):
            ids = flat[at:end]
            at = end
            if n > 1:
                # If the last space stayed single, it belongs to the run.
                ids = self._run(n) + ids[1:] if ids and ids[0] == space else self._run(n - 1) + ids
            if i in odd:
                ids = [x for s in ids for x in self._spelled(s)]
            out.append(ids)
        return out

    def _run(self, n: int) -> list[int]:
        full = max(0, n // self.longest_spaces - 1)
        return [self.ids[SPACE * self.longest_spaces]] * full + self.runs[n - full * self.longest_spaces]

    def _spelled(self, symbol: int) -> list[int]:
        """A character without a piece as bytes."""
        if symbol < self.char_limit:
            return [symbol]
        if not self.byte_ids:
            return [self.unknown]
        return [self.byte_ids[b] for b in chr(symbol - self.char_limit).encode("utf-8", "surrogatepass")]

    _CUT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def split(self, text: str) -> list[str]:
        """The words of a text, in order; joined they are the text as the model sees it."""
        if not text:
            return []
        text = text.replace(" ", SPACE)
        return self._CUT.findall(SPACE + text if self.dummy_prefix else text)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the white space that encoding put first is taken away again."""
        text = self._decode(ids)
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text

    def _decode(self, ids: list[int]) -> str:
        out, held = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            if i is not None:
                out.append(" ⁇ " if i == self.unknown else self.pieces[i].replace(SPACE, " "))
        return "".join(out)


def _utf8(data: bytes) -> str:
    """Bytes as text; every byte that begins no whole character is one replacement character."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for size in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + size].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                size = 1
            at += size
        return "".join(out)


class WordCache:
    """What a caller makes of the ids of a word, for many words; when full, only those in use stay."""

    def __init__(self, model: PieceModel, value, limit: int = REMEMBERED):
        self.model, self.value, self.limit, self.known = model, value, limit, {}

    def fill(self, words: set[str]) -> dict[str, object]:
        """A dictionary that has all these words."""
        missing = list(words - self.known.keys())
        if len(self.known) + len(missing) > self.limit:
            self.known = {w: self.known[w] for w in words if w in self.known}
        for at in range(0, len(missing), 50_000):
            part = missing[at : at + 50_000]
            for word, ids in zip(part, self.model.encode_words(part)):
                self.known[word] = self.value(word, ids)
        return self.known


_MODELS: dict[str, PieceModel] = {}
_CACHES: dict[tuple[str, str], WordCache] = {}


def piece_model(path: str) -> PieceModel:
    """The model of a file that every worker has, read once per worker."""
    if path not in _MODELS:
        with open(path, "rb") as f:
            _MODELS[path] = PieceModel(f.read())
    return _MODELS[path]


def _ids_cache(path: str) -> WordCache:
    """Tuples of ids, remembered as long as the worker lives."""
    return _CACHES.setdefault((path, "ids"), WordCache(piece_model(path), lambda _, ids: tuple(ids)))


def _digest_cache(path: str) -> WordCache:
    """Number of ids, ids as text, decoded text (None where it is the word itself)."""
    model = piece_model(path)

    def value(word: str, ids: list[int]) -> tuple[int, str, str | None]:
        decoded = model._decode(ids)
        return len(ids), ",".join(map(str, ids)), None if decoded == word.replace(SPACE, " ") else decoded

    return _CACHES.setdefault((path, "digest"), WordCache(model, value))


#: Characters of text that are worked on together; one text may be longer.
BLOCK_CHARS = 4_000_000


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        size = frame["text"].str.len().cumsum() // BLOCK_CHARS
        for _, block in frame.groupby(size, sort=False):
            yield block


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int). A null or empty text has no ids; the table's other columns are ignored."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, cache = piece_model(model_path), _ids_cache(model_path)
        for block in _blocks(frames):
            texts = [model.split(t) for t in block["text"]]
            known = cache.fill({w for t in texts for w in t})
            yield pd.DataFrame({"doc_id": block["doc_id"], "ids": [[i for w in t for i in known[w]] for t in texts]})

    rows = pair(docs, id_col, text_col)
    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of each list of ids; null ids give an empty text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = piece_model(model_path)
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "text": [model.decode([] if x is None else list(x)) for x in f["ids"]]})

    rows = encoded.selectExpr(f"`{id_col}` AS doc_id", f"`{ids_col}` AS ids")
    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, decoded again and digested in one pass."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Words end at white space, so no byte sequence crosses them and they can be decoded one by one.
        model, cache = piece_model(model_path), _digest_cache(model_path)
        for block in _blocks(frames):
            rows = []
            texts = [model.split(t) for t in block["text"]]
            known = cache.fill({w for t in texts for w in t})
            for words in texts:
                found = [known[w] for w in words]
                decoded = "".join([w.replace(SPACE, " ") if x[2] is None else x[2] for w, x in zip(words, found)])
                if model.dummy_prefix and decoded.startswith(" "):
                    decoded = decoded[1:]
                rows.append(
                    (
                        sum([x[0] for x in found]),
                        hashlib.sha256(",".join([x[1] for x in found]).encode()).hexdigest(),
                        hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest(),
                    )
                )
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", block["doc_id"].to_numpy())
            yield out

    rows = pair(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    return encode_digests(table(spark, sf_dir, "documents"), model_path)
