import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ebbtide.llm import pieces
from ebbtide.llm.jobs import JOBS, PIECES
from ebbtide.llm.pieces import PieceCodec, encode_decode
from tests.llm.helpers import FOLDER, awkward, needs_tables, table

ODD = ["", " ", "   ", "a", "▁a", " ▁ ▁▁a▁", "x" * 4000, " " * 3000, "a\nb\r\n\tc", "<s> </s> <0x0A> <unk>", "\x00\x01",
       "ñandú ﬁ Ａ ​ \U0001f600\U0001f468‍\U0001f469", "梦ข" * 40, "1234567890 " * 30, "aaaaaaaaaaaaaaaaaaaaaaab" * 90]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def own():
    return PieceCodec(PIECES)


def same(own, library, texts):
    flat, sizes = own.encode(texts)
    for text, ids in zip(texts, np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True), text
        assert own.decode(ids) == library.decode(ids.tolist()), text


def test_odd_texts(own, library):
    same(own, library, ODD)
    same(own, library, [""])


def test_heap_and_rounds_agree(own, library, monkeypatch):
    own._forget()
    monkeypatch.setattr(pieces, "LONG", 3)
    same(own, library, ODD)
    own._forget()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" ▁abeinrst\n0é"), st.characters(exclude_categories=["Cs"]))), min_size=1, max_size=5))
def test_any_text(own, library, texts):
    same(own, library, texts)


def test_forgets_words_beyond_the_bound(own, library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    for _ in range(3):
        same(own, library, ["these are more words than it keeps in mind", "these again"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 300) | st.integers(0, 31999), max_size=12))
def test_decode_any_ids(own, library, ids):
    assert own.decode(np.array(ids, np.int64)) == library.decode(ids)


@needs_tables
def test_whole_table_equals_the_library(spark, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in JOBS["op2_pieces"](spark, FOLDER).collect()}
    expected = {}
    for i, text in table("documents", "doc_id, text"):
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        back = library.decode(ids)
        expected[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    assert got == expected


def test_awkward_rows(spark, library):
    from pyspark.sql import functions as F

    frame = awkward(spark).withColumn("ids", F.lit("clash"))
    out = encode_decode(frame, PIECES)
    assert out.columns == [c for c in frame.columns if c != "ids"] + ["n_tokens", "ids", "decoded"]
    for r in out.collect():
        assert r.ids == library.encode(r.text or "", add_bos=True, add_eos=True) and r.decoded == (r.text or "")
    assert encode_decode(frame.limit(0), PIECES).count() == 0
