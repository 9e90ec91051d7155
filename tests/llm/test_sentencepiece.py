"""SentencePiece encoding against the library over whole texts, and the round trip."""

import pytest
import sentencepiece

from tessera.llm import sentencepiece as S

SCHEMA = "doc_id long, text string, token_ids string, decoded int"
TEXTS = ["", " ", "a", "Hello, world!", "  two  leading", "tabs\tand\nbreaks\n\nhere \n", "\n", "\n\n x", "Ñga çé ñü", "日本語のテキスト", "emoji 🎉🎉 x", "a" * 5000, "trailing  ", "x y", "multi   spaces    in     text", "mixed\r\nlines"]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=S.MODEL)


def test_ids_are_those_of_whole_texts(spark, model):
    rows = [(k, t, "x", 1) for k, t in enumerate([*TEXTS, None])]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in S.encode(docs).collect()}
    for k, t in enumerate(TEXTS):
        assert got[k].token_ids == model.encode(t), repr(t)
        assert got[k].n_tokens == len(got[k].token_ids)
    assert got[len(TEXTS)].token_ids is None and got[len(TEXTS)].n_tokens is None


def test_whole_table_of_documents(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = S.encode(docs).select("text", "token_ids").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.token_ids == model.encode(r.text)


def test_round_trip_and_decoding(spark):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate([*TEXTS, None, "same", "same", "word " * 100_000])], SCHEMA)
    for r in S.round_trip(docs).collect():
        assert r.round_trip is (None if r.doc_id == len(TEXTS) else True), r.doc_id
    back = {r.doc_id: (r.text, r.decoded) for r in S.decode(S.encode(docs)).collect()}
    assert all(t == d for t, d in back.values())
    assert S.encode_checked(docs).columns == ["doc_id", "text", "decoded", "token_ids", "n_tokens", "round_trip"]


def test_a_literal_mark_is_a_space(spark, model):
    import itertools

    import pyarrow as pa

    texts = ["".join(x) for n in range(1, 6) for x in itertools.product(("a", "▁", " ", "\n"), repeat=n)] + ["the▁ quick ▁▁brown▁", "▁", "▁ ▁x", "é▁▁ ▁中"]
    got = S.codec(S.MODEL).encode(pa.array(texts)).to_pylist()
    assert got == [model.encode(t) for t in texts]
    back = S.codec(S.MODEL).decode(pa.array(got, pa.list_(pa.int32()))).to_pylist()
    assert all(b == t.replace("▁", " ") for t, b in zip(texts, back))


def test_small_slices_change_nothing(spark, monkeypatch, model):
    import pyarrow as pa

    monkeypatch.setattr(S, "SLICE_BYTES", 16)
    parts = list(S._coded(pa.array(TEXTS), S.MODEL, False))
    assert len(parts) > 5 and [i for _, _, ids, _ in parts for i in ids.to_pylist()] == [model.encode(t) for t in TEXTS]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert S.encode(docs).count() == S.round_trip(docs).count() == S.decode(S.encode(docs)).count() == 0
