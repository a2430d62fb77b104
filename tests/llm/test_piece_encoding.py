"""Piece encoding against the library: ids, places and decoded text, with the model's and other character maps."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("cellweft.llm")
import sentencepiece  # noqa: E402
from sentencepiece import sentencepiece_model_pb2 as proto  # noqa: E402

from cellweft.llm import piece_encoding  # noqa: E402
from cellweft.llm.common import table  # noqa: E402
from cellweft.llm.queries import QUERIES  # noqa: E402

PATH = piece_encoding.model_path()
TOOL = piece_encoding.PieceEncoder(PATH)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
LETTERS = "ab  \u2581\u2581\u00e9\u00df\u65e5\U0001d518\u0301\n\t.,\U0001f642\0"
MAPPED = LETTERS + "\ufb01\uff11\u212b\u3000\u00a0\u200b\ufdfa\u00ad\u31f0\uff9e\uff76\u1100\u1161\u00bd\ufeff\x01\x7f"
ODD = ["", " ", "   ", "\u2581", "a\u2581", "\u2581\u2581 x", " \u2581a", "\n\n", "<s> </s> <unk>", "<0x41>", "x" * 5000, "\u2581" * 300 + "x", "   " * 50 + "y", "\u65e5\u672c\u8a9e " * 300]


def digest(text: str) -> tuple[int, str, str]:
    ids = LIBRARY.encode(text)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def agrees(text: str) -> None:
    ids, starts, ends = TOOL.encode(text)
    want = LIBRARY.encode(text, return_type="proto").pieces
    assert (ids, starts, ends) == ([p.id for p in want], [p.begin for p in want], [p.end for p in want])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text(LETTERS)))
def test_ids_and_places_are_the_library_s(text):
    agrees(text)


def test_odd_texts():
    for text in ODD:
        agrees(text)


def test_windows_change_nothing(monkeypatch):
    monkeypatch.setattr(piece_encoding, "WINDOW", 20)
    rng = random.Random(1)
    for text in ODD + ["".join(rng.choices(LETTERS, k=rng.randrange(200))) for _ in range(300)]:
        assert TOOL.digest(text)[:3] == digest(text)
        agrees(text)


@pytest.mark.parametrize("rule", ["nfkc", "nfkc_cf", "nmt_nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("change", [{}, {"add_dummy_prefix": False}, {"remove_extra_whitespaces": False}])
def test_compiled_maps(rule, change):
    """Longest prefixes, dropped spaces and places as in the library's own normaliser."""
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, **change)
    spec = proto.ModelProto.FromString(library.serialized_model_proto()).normalizer_spec
    tool = piece_encoding.PieceEncoder.__new__(piece_encoding.PieceEncoder)
    tool.spec, tool.map = spec, piece_encoding.CharMap(spec.precompiled_charsmap)
    rng = random.Random(2)
    for _ in range(1500):
        text = "".join(rng.choices(MAPPED, k=rng.randrange(14)))
        want, places = library.normalize(text, with_offsets=True)
        done, place = tool.normalise(text)
        assert done.decode() == want, repr(text)
        bounds = np.cumsum([0] + [len(c.encode()) for c in want])
        byte = np.cumsum([0] + [len(c.encode()) for c in text])
        assert not want or [int(place[b]) for b in bounds] == [int(byte[p]) for p in places], repr(text)


def test_a_model_with_a_map_and_unknown_characters(tmp_path):
    """A map in front of the vocabulary, without byte pieces: unknown runs are one piece."""
    blob = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    model = proto.ModelProto.FromString(open(PATH, "rb").read())
    model.normalizer_spec.CopyFrom(proto.ModelProto.FromString(blob).normalizer_spec)
    model.trainer_spec.byte_fallback = False
    for p in model.pieces:
        if p.type == proto.ModelProto.SentencePiece.BYTE:
            p.type = proto.ModelProto.SentencePiece.UNUSED
    path = str(tmp_path / "own.model")
    open(path, "wb").write(model.SerializeToString())
    tool, library = piece_encoding.PieceEncoder(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choices(MAPPED, k=rng.randrange(30)))
        ids, starts, ends = tool.encode(text)
        want = library.encode(text, return_type="proto").pieces
        assert ids == [p.id for p in want], repr(text)
        assert (starts, ends) == ([p.begin for p in want], [p.end for p in want]), repr(text)


def test_query(spark, sf_dir):
    rows = QUERIES["op13_piece_encoding"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == digest(texts[r.doc_id]) for r in rows)
    assert all(r.n_missed == 0 for r in rows)


def test_odd_rows(spark):
    schema = "doc_id long, text string, ids string, pieces int, n_tokens int"
    long = "word \u00e9\u4e16 " * 200_000
    docs = spark.createDataFrame([(1, "a b", "x", 7, 1), (1, "a b", "x", 7, 1), (2, None, None, None, None), (None, "", "y", 8, 2), (3, long, "z", 1, 1)], schema)
    got = piece_encoding.encode_pieces(docs, PATH).collect()
    assert got[0] == got[1] and got[0].ids == "x"
    assert (list(got[0].pieces.ids), got[0].pieces.decoded) == (LIBRARY.encode("a b"), "a b")
    assert got[2].pieces.ids == got[3].pieces.ids == [] and got[2].pieces.decoded == got[3].pieces.decoded == ""
    assert got[4].pieces.decoded == long and got[4].pieces.ends[-1] == len(long.encode())
    short = piece_encoding.encoding_digests(docs, PATH).select("doc_id", "pieces.*").collect()
    assert tuple(short[4])[1:4] == digest(long) and tuple(short[2])[1:4] == digest("")
    none = spark.createDataFrame([], schema)
    assert piece_encoding.encode_pieces(none, PATH).count() == piece_encoding.encoding_digests(none, PATH).count() == 0
