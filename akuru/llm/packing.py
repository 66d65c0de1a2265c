"""Packing documents into sequences: first-fit decreasing on a tournament tree.

Documents are encoded and cut where they are; a document's full pieces need no partner, and
only its remainder has to be packed. Pieces go to randomised groups of documents (a hash of id
and text), so a group holds a fair mix whatever the order or source of the documents, and the
groups are packed independently. What is shuffled is whatever columns the pieces still have:
callers that need digests only take them before pack().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import MEMO, encoder

#: Documents per group, on average. A group's remainders are packed in one task's memory (some 100 bytes each).
GROUP_DOCS = 4096
#: Bytes of ids per Arrow batch handed back to the JVM.
_BATCH = 8_000_000


class Tournament:
    """A tournament tree over the free room of bins: finds the first bin with enough room in O(log bins)."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(bins - 1, 0).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def first(self, size: int) -> int:
        """The leftmost bin whose room is at least size; -1 if there is none."""
        room, at = self.room, 1
        if room[1] < size:
            return -1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        return at - self.leaves

    def take(self, bin_: int, size: int) -> int:
        """Put size into the bin; gives the room it had before."""
        room, at = self.room, bin_ + self.leaves
        before = room[at]
        room[at] = before - size
        while at > 1:
            at //= 2
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
        return before


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size, the largest first and equal ones in their given order."""
    tree = Tournament(max(len(sizes), 1), capacity)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        bins[k] = b = tree.first(size)
        offsets[k] = capacity - tree.take(b, size)
    return bins, offsets


def cut(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 1024, memo: int = MEMO) -> DataFrame:
    """Pieces of each row of docs: doc_id, start, length, ids (uint32, little-endian), doc_tokens, doc_key.

    A null text is an empty one, and every document ends with end_id, so each has at least one
    piece. doc_key is a hash of id and text that all pieces of a document share; for rows that repeat
    within a task it also counts the repetition, so that equal rows don't gather in one group.
    Equal rows being alike, their order makes no difference. memo is the number of words a Python
    worker remembers (see tokens.MEMO).
    """
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc_key"), F.coalesce("text", F.lit("")).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(n, t) for n, t in (("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("doc_key", T.LongType())))])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, dtype = encoder(tokenizer, memo).encode, encoder(tokenizer, memo).dtype
        seen: dict[int, int] = {}
        for batch in batches:
            held, size = [], 0
            kind = batch.schema.field("doc_id").type
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "doc_key"]
            types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            for doc_id, key, text in zip(batch.column("doc_id"), batch.column("doc_key").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(np.frombuffer(encode(text.as_py()), dtype), end_id).astype("<u4")
                raw = ids.tobytes()
                size += len(raw)
                seen[key] = again = seen.get(key, -1) + 1
                if again:
                    key = (key + again * 0x9E3779B97F4A7C15 + 2**63) % 2**64 - 2**63
                held += [(doc_id.as_py(), k, min(capacity, len(ids) - k), raw[4 * k : 4 * (k + capacity)], len(ids), key) for k in range(0, len(ids), capacity)]
                if size > _BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    return rows.mapInArrow(split, schema)


def pack(pieces: DataFrame, documents: int, capacity: int = 1024, seed: int = 7) -> DataFrame:
    """Add sequence_id and offset to pieces (with length and doc_key); doc_key is dropped.

    documents sets the number of groups; it may be an estimate. sequence_id is the group in the
    upper and the bin in the lower 32 bits. Full pieces fill a sequence of their own.
    """
    groups = max(1, -(-documents // GROUP_DOCS))
    salted = pieces.withColumn("_p_group", F.pmod(F.xxhash64("doc_key", F.lit(seed)), F.lit(groups)))
    kept = [f for f in pieces.schema.fields if f.name != "doc_key"]
    schema = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = [f.name for f in kept]

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        # a group's rows arrive in any order, so that reruns agree they are ordered first
        group = group.sort_values(["doc_key", "start"], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
        return group[names].assign(sequence_id=(int(group["_p_group"].iloc[0]) << 32) + bins, offset=offsets)

    return salted.groupBy("_p_group").applyInPandas(fit, schema)


def crc(ids: Column) -> Column:
    """The unsigned CRC-32 of a binary column."""
    return F.crc32(ids)
