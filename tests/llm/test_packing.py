import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from akuru.llm import packing, queries
from akuru.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ENCODER = Encoder(PATH)
PLAIN = Tokenizer.from_file(PATH)
PLAIN.encode_special_tokens = True


def plain_ids(text):
    return PLAIN.encode(text, add_special_tokens=False).ids


def check_text(text):
    assert np.frombuffer(ENCODER.encode(text), ENCODER.dtype).tolist() == plain_ids(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t'sredlvmtABzü߀ßſª²½٣५文字  ‍́_!?.-9012\r\x0b\x1c\x85<|>endoftext")), max_size=60))
def test_encoder_equals_library_on_odd_texts(text):
    check_text(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40), st.text(max_size=5))
def test_encoder_equals_library_on_any_text(a, b):
    check_text(a.encode("utf-8", "ignore").decode() + " " + b.encode("utf-8", "ignore").decode() + "\n ok it's fine")


def test_tournament_equals_a_scan():
    rng = random.Random(3)
    sizes = np.array([rng.randrange(1, 1025) for _ in range(700)])
    bins, offsets = packing.first_fit_decreasing(sizes, 1024)
    room = []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        b = next((i for i, r in enumerate(room) if r >= sizes[k]), len(room))
        room += [1024] * (b == len(room))
        assert (bins[k], offsets[k]) == (b, 1024 - room[b])
        room[b] -= sizes[k]


def check_packed(rows, docs):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 1024
    for doc_id, text in docs:
        ids = [*plain_ids(text or ""), 0]
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    return sum(r.length for r in rows) / (1024 * len(by_seq))


def test_whole_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = queries.op5_packing(spark, sf).collect()
    assert check_packed(rows, docs) > 0.97
    assert sorted(rows) == sorted(queries.op5_packing(spark, sf).collect())


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "long text " * 5000), (4, "same"), (4, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as length", "'y' as ids")
    out = packing.pack(packing.cut(df, PATH), 6).collect()
    assert sum(r.doc_tokens for r in out if r.start == 0) == sum(len(plain_ids(t or "")) + 1 for _, t in rows)
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out)


@pytest.mark.parametrize("rows", [[]])
def test_empty(spark, rows):
    assert packing.pack(packing.cut(spark.createDataFrame(rows, "doc_id long, text string"), PATH), 0).count() == 0
