import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm.pieces import ChunkTable, decode_pieces, encode_pieces, piece_digests, read_model, separable

from .fixtures import TEXTS, frame

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return read_model(PATH)


def test_model_is_separable(model):
    assert separable(model)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n▁abtheingé漢🙂.")), max_size=40))
def test_equals_library(text):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    table = ChunkTable(read_model(PATH), most=50)
    ids = lib.encode(text)
    assert table.encode([text]) == [ids]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert list(table.digests([text])) == [(len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)))]


def test_common_chunks_are_segmented_once(model):
    table, seen = ChunkTable(model, most=20), []
    encode = table.lib.encode

    class Counting:
        def __getattr__(self, name):
            return getattr(lib, name)

        def encode(self, texts, **kw):
            seen.extend(texts)
            return encode(texts, **kw)

    lib, table.lib = table.lib, Counting()
    for i in range(50):
        table.encode([f"the common words x{i}a x{i}b x{i}c"])
    assert seen.count("the") == seen.count("words") == 1 and len(table.ids) + len(table.before) < 60


def test_documents_equal_library(spark, sf, lib, model):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for r in piece_digests(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect():
        ids = lib.encode(r.text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_edge_rows_and_round_trip(spark, lib, model):
    ids = encode_pieces(frame(spark), model)
    back = {r.doc_id: r.text for r in decode_pieces(ids, model).collect()}
    assert back == {**{i: lib.decode(lib.encode(t or "")) for i, t in enumerate(TEXTS)}, None: "no id"}
    assert piece_digests(frame(spark), model).count() == len(TEXTS) + 2
    assert piece_digests(frame(spark, []), model).count() == 0
