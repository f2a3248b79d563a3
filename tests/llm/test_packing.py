import random
import zlib

import numpy as np
import pytest

from idveil.llm import packing

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public.path("word_bpe_49k.json")


def check(rows, capacities):
    """Every constraint holds, offsets are gapless, and every piece has one place."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    limit = capacities.vector()
    for members in by.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        use = np.array([at, len(members), sum(n * n for _, n in members)])
        assert (use <= limit).all()
    return len(by)


def test_ids_equal_library(spark, sf_dir, texts):
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    rows = packing.op6_packing(spark, sf_dir).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by.keys() == texts.keys()
    for doc_id, parts in by.items():
        ids = tokenizer.encode(texts[doc_id], add_special_tokens=False).ids + [packing.END_ID]
        parts.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(-(-len(ids) // 2048)))
        for r in parts:
            own = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == 2048 * r["piece"] and len(own) == r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
    used = check(rows, packing.Capacities())
    assert used <= 1 + 1.01 * sum(r["length"] for r in rows) / 2048


@pytest.mark.parametrize("text", ["It's <|endoftext|> A", "Σίσυφος ΣΑΣ İI", "é  x\x85y", "日本語 ١٢٣ 'S'LL", "<|STARTOFTEXT|>", "it's. a... b?! c.d, 'e.' f., g.\u0301 h.\x0bi, é. 1. x;", "End."])
def test_chunks_give_the_ids_of_the_text(text):
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    known = packing._chunk_ids(PATH, set(packing._chunks(text)))
    ids = np.frombuffer(b"".join(known[c] for c in packing._chunks(text)), "<u4").tolist()
    assert ids == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(spark, rule):
    rng = random.Random(5)
    rows = [(i, 0, rng.choice([1, 3, 40, 100, 100, 700, 1500, 2048])) for i in range(2000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    capacities = packing.Capacities(documents=12, attention=2048 * 2048, rule=rule, weights=(1, 1, 1))
    packed = packing.pack(pieces, capacities).collect()
    assert sorted(r["doc_id"] for r in packed) == list(range(2000))
    check(packed, capacities)
    with pytest.raises(ValueError):
        packing.plan_slots({2049: 1}, packing.Capacities())


def test_awkward_rows(awkward, empty):
    rows = packing.pack_documents(awkward, PATH, with_ids=True)
    found = rows.collect()
    assert sum(r["piece"] == 0 for r in found) == awkward.count()
    check(found, packing.Capacities())
    assert sum(len(r["ids"]) for r in packing.sequences(rows).collect()) == sum(r["length"] for r in found)
    assert packing.pack_documents(empty, PATH).count() == 0


def test_memory_of_chunks_keeps_what_is_met_again(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    for text in ["one two three four", "one five", "six seven eight nine ten", "one two", "", "ten one"]:
        known = packing._chunk_ids(PATH, set(packing._chunks(text)))
        ids = np.frombuffer(b"".join(known[c] for c in packing._chunks(text)), "<u4").tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(packing._TOKENIZERS[PATH][1]) <= 8


def test_clashing_names(spark):
    pieces = spark.createDataFrame([(i, 0, 1 + i % 5, "x", 7) for i in range(50)], "doc_id long, piece int, length long, __rank string, ___n int")
    packed = packing.pack(pieces)
    assert packed.columns == [*pieces.columns, "sequence_id", "offset"]
    check(packed.collect(), packing.Capacities())
    with pytest.raises(ValueError, match="offset"):
        packing.pack(pieces.withColumnRenamed("__rank", "offset"))


def test_signs_at_the_ends_of_words_make_no_new_words():
    words = ["lami", "café", "ÀÉx"]
    text = " ".join(w + sign for w in words for sign in ["", "###", ".%%%", "&", "',", "?!"])
    assert {c for c in packing._chunks(text) if c.decode()[0].isalpha()} == {"lami".encode(), "café".encode(), "ÀÉx".encode()}
    assert packing._chunks("x×, …, é\u0301, 1,") == ["x×,".encode(), "…,".encode(), "é\u0301,".encode(), b"1,"]


def test_words_of_letters_are_encoded_in_lines():
    """One text for many words; a line where a word is more than one to the tokenizer is encoded word by word."""
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    words = [f"l{a}m{b}".encode() for a in "aeiouäéß" for b in "aeiouñø日"]
    found, alone = packing._line_ids(PATH, tokenizer, words)
    assert not alone and found.keys() == set(words)
    for w, ids in found.items():
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(w.decode(), add_special_tokens=False).ids
    assert packing._line_ids(PATH, tokenizer, ["x".encode(), "İx".encode()]) == ({}, ["x".encode(), "İx".encode()])
