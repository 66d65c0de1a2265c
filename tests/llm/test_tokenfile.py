import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from akuru.llm import queries, tokenfile
from akuru.llm.common import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=2000), st.integers(1, 9), st.integers(1, 7))
def test_round_trip_and_checkpoints(values, lanes, every):
    ids = np.array(values, np.uint32)
    table = tokenfile.Table(tokenfile.normalise(np.bincount(ids, minlength=301)))
    lanes, marks, words = tokenfile.encode_ids(ids, table, lanes, every)
    assert (tokenfile.decode_ids(len(ids), lanes, every, marks, words, table) == ids).all()
    for k in range(len(marks)):
        part = tokenfile.decode_ids(len(ids), lanes, every, marks, words, table, k, k + 1)
        assert (part == ids[k * every * lanes : (k + 1) * every * lanes]).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10**12), min_size=1, max_size=400))
def test_frequencies_are_whole(counts):
    counts = np.array(counts, np.int64)
    freq = tokenfile.normalise(counts)
    assert ((freq > 0) == (counts > 0)).all()
    assert freq.sum() == (2**20 if counts.sum() else 0)


def test_size_is_near_the_entropy():
    rng = np.random.default_rng(1)
    ids = (rng.zipf(1.3, 600_000) % 5000).astype(np.uint32)
    n = np.bincount(ids)
    bits = -(n[n > 0] * np.log2(n[n > 0] / len(ids))).sum()
    raw = tokenfile.write_block([1], np.array([len(ids)]), ids, tokenfile.Table(tokenfile.normalise(n)))
    assert len(raw) * 8 < 1.05 * bits + 64 * 4096


def test_damage_is_found():
    ids = np.arange(5000, dtype=np.uint32) % 70
    table = tokenfile.Table(tokenfile.normalise(np.bincount(ids)))
    raw = bytearray(tokenfile.write_block([4, None], np.array([2000, 3000]), ids, table))
    doc_ids, lengths, back = tokenfile.read_block(bytes(raw), table)
    assert doc_ids == [4, None] and lengths.tolist() == [2000, 3000] and (back == ids).all()
    raw[-3] ^= 4
    with pytest.raises(ValueError):
        tokenfile.read_block(bytes(raw), table)
    with pytest.raises(ValueError):
        tokenfile.Table.from_bytes(table.to_bytes()[:-1] + b"x")


def want(rows):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    at, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_whole_query(spark, sf, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 3000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op7_token_output(spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(want(rows))


def test_edge_rows(spark):
    from pyspark.sql import functions as F

    rows = [(5, "b c"), (None, "last"), (2, None), (3, ""), (-1, "long text " * 9000), (9, "same"), (9, "same")]
    path = scratch_path(spark, "test")
    tokenfile.write(spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")), PATH, path)
    got = tokenfile.read(spark, path).withColumn("c", F.crc32("ids")).select("doc_id", "start", "n_tokens", "c").orderBy("start").collect()
    assert [tuple(r) for r in got] == want(rows)


def test_empty(spark):
    path = scratch_path(spark, "test")
    tokenfile.write(spark.createDataFrame([], "doc_id long, text string"), PATH, path)
    assert tokenfile.read(spark, path).count() == 0
    with pytest.raises(TypeError):
        tokenfile.write(spark.createDataFrame([], "doc_id string, text string"), PATH, path)
