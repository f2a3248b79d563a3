import hashlib
import random

import pytest

from idveil.llm import pieces

public = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = public.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def encode(text):
    model = pieces.piece_model(PATH)
    return [i for w in model.encode_words(model.split(text)) for i in w]


def test_equals_library_on_odd_texts(library):
    rng = random.Random(7)
    model = pieces.piece_model(PATH)
    letters = "ab  \n\tthe▁ inonSé日本€😀\x00\x01.,aa"
    for k in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        if k % 5 == 0:
            text = " " * rng.randint(0, 50) + text + " " * rng.randint(0, 40)
        assert encode(text) == library.encode(text), repr(text)
        assert model.decode(encode(text)) == library.decode(library.encode(text)), repr(text)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "=-" * 2000, " " * 5000, "-" * 777, "the" * 1000, "ha" * 50 + "x"])
def test_long_words(library, text):
    assert encode(text) == library.encode(text)


def test_decodes_any_ids(library):
    rng = random.Random(3)
    model = pieces.piece_model(PATH)
    for _ in range(300):
        ids = [rng.randint(3, 31999) for _ in range(20)]
        assert model.decode(ids) == library.decode(ids)


def test_query_equals_library(spark, sf_dir, texts, library):
    for r in pieces.op7_sentencepiece(spark, sf_dir).collect():
        ids = library.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_round_trip_of_tables(awkward, empty):
    rows = awkward.dropDuplicates(["doc_id"]).where("doc_id IS NOT NULL")
    encoded = pieces.encode(rows, PATH)
    back = {r["doc_id"]: r["text"] for r in pieces.decode(encoded, PATH).collect()}
    for r in rows.collect():
        assert back[r["doc_id"]] == (r["text"] or "").replace("▁", " ")
    assert pieces.encode_digests(empty, PATH).count() == 0
    assert pieces.encode_digests(awkward, PATH).count() == awkward.count()
