import os
import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelmill.llm import pieces
from labelmill.llm.pieces import Decoder, Encoder, Vocabulary, decoded, encoded

MODEL = os.environ.get("LABELMILL_PIECES_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")


@pytest.fixture(scope="module")
def encoder():
    return Encoder(Vocabulary(MODEL))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), np.int32).tolist()


def test_equals_library_on_documents(spark, sf, encoder, library):
    for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect():
        assert ids(encoder, r.text) == library.encode(r.text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("abcdeinorst ▁\n\t.é–東京1", max_size=80))
def test_equals_library_on_any_text(encoder, library, text):
    assert ids(encoder, text) == library.encode(text)


def test_long_text_without_blanks(encoder, library):
    rng = random.Random(2)
    text = "".join(rng.choice("aeinrstol") for _ in range(6000)) + "ab" * 500
    assert ids(encoder, text) == library.encode(text)
    assert ids(encoder, " " * 1000 + "x") == library.encode(" " * 1000 + "x")


def test_round_trip(spark, library):
    texts = ["", None, " ", "a", "  two  blanks ", "é 東京\n\n\ttab", "<s> </s> <0x41>", "x" * 5000, "a\x00b", "▁x"]
    df = spark.createDataFrame([(i, t, "old", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n int")
    coded = encoded(df, MODEL)
    assert coded.columns == ["doc_id", "n", "ids"]
    for r in coded.collect():
        assert r.ids == library.encode(texts[r.doc_id] or "")
    for r in decoded(coded, MODEL).collect():
        assert r.text == (texts[r.doc_id] or "").replace("▁", " ")
    strange = spark.createDataFrame([(1, [-5, 99999, 3 + 0xFF, 264]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [r.text for r in decoded(strange, MODEL).collect()] == ["� a", "", ""]
    assert encoded(df.limit(0), MODEL).count() == 0


def test_query_gives_the_ids(spark, sf):
    from labelmill.llm import queries

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: r.ids for r in encoded(docs, queries.PIECES_MODEL).collect()}
    got = {r.doc_id: r for r in queries.op10_streaming_viterbi(spark, sf).collect()}
    assert {i: r.ids for i, r in got.items()} == want and all(r.n_ids == len(r.ids) for r in got.values())


def test_slices_and_lanes_change_nothing(spark, sf, library, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()] + ["", "x" * 700, "ab " * 300]
    for block, abreast in ((300, 1), (1 << 20, 10**9), (97, 10**9)):
        monkeypatch.setattr(pieces, "BLOCK", block)
        monkeypatch.setattr(pieces, "ABREAST", abreast)
        encoder = Encoder(Vocabulary(MODEL))
        assert [ids(encoder, t) for t in texts] == library.encode(texts)


def test_a_million_characters_without_blanks(encoder, library):
    rng = random.Random(4)
    text = "".join(rng.choice("aeinrstolcdmu") for _ in range(1_000_000))
    assert ids(encoder, text) == library.encode(text)
    # no two of these stand together in a piece: paths converge everywhere
    assert ids(encoder, "\x01\x02" * 500_000) == library.encode("\x01\x02" * 500_000)


def field(number, value):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def written(path, entries, trainer, normalizer):
    """A model file made of (piece, score, kind)."""
    data = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in entries)
    path.write_bytes(data + field(2, trainer) + field(3, normalizer))
    return str(path)


def unigram(path, bytes_too, remove_extra=0, kinds=()):
    rng = random.Random(6)
    entries = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *kinds]
    if bytes_too:
        entries += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    known = {"▁", *"abcdeno rst".replace(" ", "é")}
    known |= {"".join(rng.choice("▁abcdenorsté") for _ in range(rng.randint(2, 6))) for _ in range(900)}
    entries += [(p, -rng.random() * 12 - 1, 1) for p in sorted(known)]
    normalizer = field(1, b"identity") + field(3, 1) + field(4, remove_extra) + field(5, 1)
    return written(path, entries, field(3, 1) + field(35, int(bytes_too)), normalizer)


@pytest.mark.parametrize("bytes_too, remove_extra", [(False, 0), (True, 0), (False, 1), (True, 1)])
def test_unigram_models_equal_the_library(tmp_path, bytes_too, remove_extra, monkeypatch):
    import sentencepiece

    path = unigram(tmp_path / "m.model", bytes_too, remove_extra)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcdenorst  éxy東京\n") for _ in range(rng.randint(0, 90))) for _ in range(400)] + ["", " ", "  a  b  ", "xx yy", "東京xx a"]
    for abreast in (1, 10**9):
        monkeypatch.setattr(pieces, "ABREAST", abreast)
        encoder = Encoder(Vocabulary(path))
        got = [ids(encoder, t) for t in texts]
        assert got == library.encode(texts)
    if bytes_too and not remove_extra:
        ends = np.cumsum([0, *map(len, got)])
        assert Decoder(encoder.v).decode_rows(np.array(sum(got, []), np.int32), ends).to_pylist() == texts


def test_other_models_are_refused(tmp_path):
    for path in (unigram(tmp_path / "a.model", False, 0, [("abc", 0.0, 4)]), written(tmp_path / "b.model", [("<unk>", 0.0, 2), ("a", 0.0, 1)], field(3, 3), field(4, 0))):
        with pytest.raises(ValueError):
            Vocabulary(path)
