"""Token files: documents encoded to ids and compressed by a static range asymmetric numeral system.

A data set is a folder with ``table.akf`` (the shared frequency table), ``part-*.aks`` files of
blocks, and a ``manifest`` table with one row per block. Layout, all little-endian:

* table.akf: magic ``AKF1``, uint32 scale bits, uint32 vocabulary, then a uint32 frequency per id
  (summing to 2 ** scale bits, at least 1 for ids that occur), then the CRC-32 of all before it.
* part file: blocks, back to back. A block holds whole documents in order: magic ``AKS1``, uint32
  CRC-32 of the rest of the block, uint32 CRC-32 of the table, uint32 documents, uint64 ids, uint32
  lanes, uint32 checkpoint distance in steps, uint64 words, uint32 checkpoints; int64 document ids,
  uint8 null flags and uint64 lengths; checkpoints (uint64 word position, then a uint64 state per
  lane), then the uint32 words.

Id k of a block belongs to lane k % lanes at step k // lanes; lanes are coded side by side.
Every checkpoint holds all lanes' states, so each stretch between two of them can be decoded on
its own, as can each block. Which attempt of a task wrote a file does not matter: the manifest
names only files of committed tasks.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete, scratch_path
from .tokens import TOGETHER, encoder

SCALE_BITS = 20
#: A block is closed by the document that brings it to this number of ids.
BLOCK_IDS = 1 << 21
LANES = 4096
CHECKPOINT_STEPS = 256
#: Bytes of blocks per part file, at least.
FILE_BYTES = 32_000_000
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_HEAD = struct.Struct("<4sI")
_BODY = struct.Struct("<IIQIIQI")


def normalise(counts: np.ndarray, scale_bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies proportional to counts that sum to 2 ** scale_bits, at least 1 where a count is."""
    total, whole = int(counts.sum()), 1 << scale_bits
    if not total:
        return np.zeros(len(counts), np.uint32)
    freq = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) * whole // total), 0).astype(np.int64)
    order = np.argsort(-freq, kind="stable")
    k, off = 0, whole - int(freq.sum())
    while off:
        at = order[k % len(order)]
        step = off if off > 0 else -min(-off, max(int(freq[at]) // 2, 0))
        freq[at] += step
        off -= step
        k += 1
    return freq.astype(np.uint32)


class Table:
    """A frequency table with its cumulative sums and slot look-up."""

    def __init__(self, freq: np.ndarray, scale_bits: int = SCALE_BITS) -> None:
        self.bits = scale_bits
        self.freq32 = freq.astype("<u4")
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64) if len(freq) else self.freq
        self.crc = zlib.crc32(self.head())
        self.limit = self.freq << np.uint64(63 - scale_bits)
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        """The id of each slot, in the smallest type: look-ups should stay in a processor's cache."""
        if self._slots is None:
            kind = np.uint16 if len(self.freq32) <= 1 << 16 else np.uint32
            self._slots = np.repeat(np.arange(len(self.freq32), dtype=kind), self.freq32)
        return self._slots

    def head(self) -> bytes:
        return struct.pack("<4sII", b"AKF1", self.bits, len(self.freq32)) + self.freq32.tobytes()

    def to_bytes(self) -> bytes:
        return self.head() + struct.pack("<I", self.crc)

    @staticmethod
    def from_bytes(raw: bytes) -> Table:
        magic, bits, size = struct.unpack_from("<4sII", raw)
        if magic != b"AKF1" or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("the frequency table is damaged")
        return Table(np.frombuffer(raw, "<u4", size, 12), bits)


def encode_ids(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = CHECKPOINT_STEPS) -> tuple[int, list[tuple[int, np.ndarray]], np.ndarray]:
    """Lanes, checkpoints (word position, states) from the first step on, and words of a block."""
    lanes = max(1, min(lanes, -(-len(ids) // 64)))
    steps = -(-len(ids) // lanes)
    state = np.full(lanes, _LOW, np.uint64)
    bits = np.uint64(table.bits)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    written = 0
    for step in range(steps - 1, -1, -1):
        at = ids[step * lanes : (step + 1) * lanes].astype(np.intp)
        x = state[: len(at)]
        over = np.flatnonzero(x >= table.limit.take(at, mode="clip"))
        if len(over):
            out = x[over]
            words.append(out.astype(np.uint32))
            written += len(out)
            x[over] = out >> _WORD
        f = table.freq.take(at, mode="clip")
        q = x // f
        x -= q * f
        q <<= bits
        x += q
        x += table.cum.take(at, mode="clip")
        if step % every == 0:
            marks.append((written, state.copy()))
    stream = np.concatenate(words[::-1]).astype("<u4") if words else np.zeros(0, "<u4")
    return lanes, [(written - w, s) for w, s in marks[::-1]], stream


def decode_ids(count: int, lanes: int, every: int, marks: list[tuple[int, np.ndarray]], words: np.ndarray, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids from checkpoint first up to checkpoint last (the end if None)."""
    steps = -(-count // lanes)
    begin, end = first * every, steps if last is None else min(steps, last * every)
    if end <= begin:
        return np.zeros(0, np.uint32)
    at, state = marks[first][0], marks[first][1].copy()
    bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    out = np.empty(min(count, end * lanes) - begin * lanes, np.uint32)
    symbol, freq, cum = table.slots, table.freq, table.cum
    words = words.astype(np.uint64)
    for step in range(begin, end):
        n = min(lanes, count - step * lanes)
        x = state[:n]
        slot = (x & mask).view(np.int64)
        ids = symbol.take(slot, mode="clip")
        out[(step - begin) * lanes :][:n] = ids
        x >>= bits
        x *= freq.take(ids, mode="clip")
        x += slot.view(np.uint64)
        x -= cum.take(ids, mode="clip")
        low = np.flatnonzero(x < _LOW)
        if len(low):
            x[low] = (x[low] << _WORD) | words[at : at + len(low)]
            at += len(low)
    return out


def write_block(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, table: Table) -> bytes:
    lanes, marks, words = encode_ids(ids, table)
    body = [
        _BODY.pack(table.crc, len(doc_ids), len(ids), lanes, CHECKPOINT_STEPS, len(words), len(marks)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(), lengths.astype("<u8").tobytes(),
        *(struct.pack("<Q", w) + s.astype("<u8").tobytes() for w, s in marks), words.tobytes(),
    ]
    raw = b"".join(body)
    return _HEAD.pack(b"AKS1", zlib.crc32(raw)) + raw


def read_block(raw: bytes, table: Table) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths and ids of a block; ValueError if it is damaged or of another table."""
    magic, crc = _HEAD.unpack_from(raw)
    if magic != b"AKS1" or zlib.crc32(memoryview(raw)[_HEAD.size :]) != crc:
        raise ValueError("the block is damaged")
    table_crc, docs, count, lanes, every, n_words, n_marks = _BODY.unpack_from(raw, _HEAD.size)
    if table_crc != table.crc:
        raise ValueError("the block was written with another frequency table")
    at = _HEAD.size + _BODY.size
    doc_ids, nulls, lengths = np.frombuffer(raw, "<i8", docs, at), np.frombuffer(raw, np.uint8, docs, at + 8 * docs), np.frombuffer(raw, "<u8", docs, at + 9 * docs)
    at += 17 * docs
    marks = []
    for _ in range(n_marks):
        marks.append((struct.unpack_from("<Q", raw, at)[0], np.frombuffer(raw, "<u8", lanes, at + 8).astype(np.uint64)))
        at += 8 + 8 * lanes
    ids = decode_ids(count, lanes, every, marks, np.frombuffer(raw, "<u4", n_words, at), table)
    return [None if z else int(d) for d, z in zip(doc_ids, nulls, strict=True)], lengths.astype(np.int64), ids


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _put(path: str, raw: bytes) -> None:
    at, inner = _open(path)
    at.create_dir(inner.rpartition("/")[0], recursive=True)
    with at.open_output_stream(inner) as out:
        out.write(raw)


def _get(path: str, offset: int = 0, length: int | None = None) -> bytes:
    at, inner = _open(path)
    with at.open_input_file(inner) as f:
        f.seek(offset)
        return f.read() if length is None else f.read(length)


@lru_cache(maxsize=4)
def _table(path: str) -> Table:
    return Table.from_bytes(_get(path))


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2) -> None:
    """Encode each row's text, append end_id, and write a data set in ascending order of doc_id.

    path must be a folder that driver and executors share. Null texts count as empty. Null ids
    come last, and rows with equal ids are in the order of a hash of their texts. doc_id must be
    an integer column. An empty table gives a data set without blocks.
    """
    spark = docs.sparkSession
    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError("doc_id must be an integer column")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], pa.Array]]:
        """Ids and texts of so many batches that they are encoded together."""

        def rows() -> tuple[list[int | None], pa.Array]:
            whole = pa.Table.from_batches(held)
            return whole.column("doc_id").to_pylist(), whole.column("text").cast(pa.large_string()).combine_chunks()

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= TOGETHER:
                yield rows()
                held, size = [], 0
        if held:
            yield rows()

    def raw_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of plain ids, with how often each id occurs in the partition on the last one."""
        code = encoder(tokenizer, 200_000)
        counts, shard, block = np.zeros(max(code.vocabulary, end_id + 1), np.int64), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        size = 0

        def close(last: bool) -> pa.RecordBatch:
            nonlocal counts, block
            flat = np.concatenate(ids)
            counts += np.bincount(flat, minlength=len(counts))
            row = pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "width": pa.array([code.dtype.itemsize], pa.int32()), "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())), "lengths": pa.array([lengths], pa.list_(pa.int64())), "ids": pa.array([flat.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes() if last else None], pa.binary())})
            block += 1
            ids.clear(), doc_ids.clear(), lengths.clear()
            return row

        for named, texts in gathered(batches):
            at = 0
            for flat, sizes in code.encode_many(texts, end_id):
                for doc_id, n, to in zip(named[at : at + len(sizes)], sizes.tolist(), np.cumsum(sizes).tolist(), strict=True):
                    if size >= BLOCK_IDS:
                        yield close(False)
                        size = 0
                    ids.append(flat[to - n : to])
                    doc_ids.append(doc_id)
                    lengths.append(n)
                    size += n
                at += len(sizes)
        if doc_ids:
            yield close(True)

    raw_path = scratch_path(spark, "raw-ids")
    rows.mapInArrow(raw_blocks, "shard int, block int, width int, doc_ids array<long>, lengths array<long>, ids binary, counts binary").write.option("compression", "lz4_raw").parquet(raw_path)
    raw = spark.read.parquet(raw_path)
    table = Table(normalise(_counts(raw)))
    spark.createDataFrame([(bytearray(table.to_bytes()),)], "raw binary").foreach(lambda r: _put(f"{path}/table.akf", bytes(r.raw)))

    def code_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], [], 0
        at = _table(f"{path}/table.akf")

        def flush() -> pa.RecordBatch:
            name = f"{path}/part-{rows[0][0]:06d}-{rows[0][1]:06d}-{uuid.uuid4().hex}.aks"
            _put(name, b"".join(held))
            cols = list(zip(*rows, strict=True))
            out = pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), *(pa.array(c, pa.int64()) for c in cols)], ["path", "shard", "block", "documents", "ids", "offset", "bytes"])
            held.clear(), rows.clear()
            return out

        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], f"<u{r['width']}")
                held.append(write_block(r["doc_ids"], np.array(r["lengths"], np.int64), ids, at))
                rows.append((r["shard"], r["block"], len(r["doc_ids"]), len(ids), size, len(held[-1])))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield flush()
                    size = 0
        if rows:
            yield flush()

    blocks = raw.select("shard", "block", "width", "doc_ids", "lengths", "ids").mapInArrow(code_blocks, "path string, shard long, block long, documents long, ids long, offset long, bytes long")
    blocks.write.parquet(f"{path}/manifest")
    delete(spark, raw_path)


def _counts(raw: DataFrame) -> np.ndarray:
    """How often each id occurs: summed within tasks, then by id; one row per id reaches the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for c in batch.column("counts"):
                if c.is_valid:
                    one = np.frombuffer(c.as_py(), np.int64)
                    total = one.copy() if not len(total) else total + one
        if len(total):
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["id", "n"])

    got = raw.select("counts").mapInArrow(sums, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = got.column("id").to_numpy(), got.column("n").to_numpy()
    out = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
    out[ids] = n
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (uint32, little-endian) of each document of a data set.

    start counts the ids of all documents before it. Blocks are decoded in parallel, each from
    its place in its file; a damaged block raises an error.
    """
    blocks = spark.read.parquet(f"{path}/manifest")
    shards = blocks.groupBy("shard").agg(F.sum("ids").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    places = blocks.join(shards, "shard").withColumn("base", F.col("before") + F.coalesce(F.sum("ids").over(inside), F.lit(0)))
    places = places.select("path", "offset", "bytes", "base").repartition(max(1, min(10_000, places.count())), "path", "offset")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                table = _table(r["path"].rpartition("/")[0] + "/table.akf")
                doc_ids, lengths, ids = read_block(_get(r["path"], r["offset"], r["bytes"]), table)
                ends = np.cumsum(lengths)
                raw = ids.astype("<u4").tobytes()
                texts = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(r["base"] + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return places.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")
