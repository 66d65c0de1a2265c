"""Nearest neighbours by additive quantisation.

A vector is approximated by the sum of one codeword from each of several full-dimensional
codebooks, trained on residuals and encoded by beam search. A query's inner products with all
codewords form a look-up table, so scoring a code is a sum of look-ups. Every vector whose
approximate score, given the stored norm of its residual, could reach a query's best is reranked
exactly: how many that are follows from the data, not from a cap.

The first codeword (with many vectors, the first two) names a vector's cell. A query first visits
its nearest cells, whose exact scores give it a bar: its k-th best can't be below. Then it visits
those cells of which a vector, given the largest residual in the cell, could reach the bar. Cells
lie in blocks of bounded size, large ones in several; a block's vectors meet the queries routed to it
in tasks of bounded size, so a vector moves once and again only for each further group of queries.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize

#: Training vectors, at most: those with the smallest hash of their id.
MAX_TRAIN = 8192
BOOKS, WORDS, BEAM = 8, 256, 4
#: Vectors of a block and queries of a task, on average.
BLOCK_VECTORS, BLOCK_QUERIES = 8192, 2048
#: Vectors from which on the first two codewords name a cell.
TWO_WORDS = 2_000_000
#: Cells a query visits for its bar, and approximate scores reranked there per result.
FIRST_CELLS, FIRST = 4, 4
#: Standard deviations of a residual's inner product with a query that an approximate score may be off.
SLACK = 3.0


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """At most k centres; fewer if there are fewer vectors."""
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=k)])
    return centres.astype(np.float32)


def encode(x: np.ndarray, books: list[np.ndarray], beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (a column per book) and the residuals left, by beam search."""
    n, d = x.shape
    codes = np.zeros((n, 1, len(books)), np.uint8)
    left = x[:, None, :].astype(np.float32)
    for m, book in enumerate(books):
        width = left.shape[1]
        gain = (book**2).sum(axis=1)[None, None, :] - 2 * (left.reshape(-1, d) @ book.T).reshape(n, width, -1)
        cost = (gain + (left**2).sum(axis=2)[:, :, None]).reshape(n, -1)
        keep = min(beam if m + 1 < len(books) else 1, cost.shape[1])
        best = np.argpartition(cost, keep - 1, axis=1)[:, :keep]
        from_, word = best // len(book), best % len(book)
        rows = np.arange(n)[:, None]
        left = left[rows, from_] - book[word]
        codes = codes[rows, from_]
        codes[:, :, m] = word
    return codes[:, 0], left[:, 0]


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 1) -> list[np.ndarray]:
    """Codebooks for the rows of x, each trained on what beam search with the ones before leaves."""
    rng, out, left = np.random.default_rng(seed), [], x
    for _ in range(books):
        out.append(kmeans(left, words, rng))
        _, left = encode(x, out, beam=2)
    return out


def exact(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision; equal vectors get equal products, whatever their place."""
    return (vectors.astype(np.float64) * queries.astype(np.float64)).sum(axis=1)


def nearest(near: np.ndarray) -> np.ndarray:
    """Which cells are the FIRST_CELLS nearest of each row."""
    chosen = np.zeros(near.shape, bool)
    count = min(FIRST_CELLS, near.shape[1])
    np.put_along_axis(chosen, np.argpartition(-near, count - 1, axis=1)[:, :count], True, axis=1)
    return chosen


@dataclass
class Cells:
    """What routing needs to know of the occupied cells: their codewords, largest residual norm and first block of several."""

    books: list[np.ndarray]
    words: np.ndarray  # a row per cell: codewords that name it
    reach: np.ndarray
    first: np.ndarray
    blocks: np.ndarray

    def nearness(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of queries with the cells' centres, a row per query."""
        out = np.zeros((len(queries), len(self.words)), np.float32)
        for m in range(self.words.shape[1]):
            out += (queries @ self.books[m].T)[:, self.words[:, m]]
        return out

    def route(self, queries: np.ndarray, bars: np.ndarray | None) -> list[np.ndarray]:
        """The blocks each query has to visit: those of its nearest cells, or of the cells that could reach its bar."""
        out = []
        for at in range(0, len(queries), 256):
            some = queries[at : at + 256]
            near = self.nearness(some)
            chosen = nearest(near) if bars is None else self.could(near, some, bars[at : at + 256])
            for row in chosen:
                out.append(np.unique(np.concatenate([np.arange(f, f + n) for f, n in zip(self.first[row], self.blocks[row], strict=True)] or [np.zeros(0, int)])))
        return out

    def could(self, near: np.ndarray, queries: np.ndarray, bars: np.ndarray) -> np.ndarray:
        norms = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        return near + norms[:, None] * (SLACK * self.reach / math.sqrt(queries.shape[1])) >= bars[:, None]


def search_block(block: dict[str, np.ndarray], books: list[np.ndarray], queries: dict[str, np.ndarray], k: int, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of each query's k best in the block, by position; a query's own row is left out.

    At first only the best by approximate score of the nearest cells are reranked. Later every vector that could reach
    the query's bar is; a cell that can't is passed over.
    """
    flat, x = np.concatenate(books), block["x"]
    offsets = np.cumsum([0, *(len(b) for b in books)])[:-1]
    columns = block["codes"].astype(np.intp) + offsets
    q = queries["x"].astype(np.float32)
    norms = np.sqrt((queries["x"].astype(np.float64) ** 2).sum(axis=1))
    spread = SLACK * block["error"] / math.sqrt(x.shape[1])
    order = np.argsort(block["cell"], kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(block["cell"][order]) != 0])
    cells = np.split(order, starts[1:])
    named = block["named"][order[starts]]
    reach = SLACK * np.array([block["coarse"][c].max() for c in cells]) / math.sqrt(x.shape[1])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(q), 256):
        table = q[at : at + 256] @ flat.T
        bars = queries["bar"][at : at + 256]
        near = sum(table[:, offsets[m] + named[:, m]] for m in range(named.shape[1]))
        open_ = nearest(near) if first else near + norms[at : at + 256, None] * reach >= bars[:, None]
        pairs_q, pairs_v = [], []
        for c, rows in enumerate(cells):
            asked = np.flatnonzero(open_[:, c])
            if not len(asked):
                continue
            score = np.zeros((len(asked), len(rows)), np.float32)
            for m in range(columns.shape[1]):
                score += table[asked[:, None], columns[rows, m]]
            if first:
                n = min(FIRST * k + 1, len(rows))
                v = np.argpartition(-score, n - 1, axis=1)[:, :n]
                i = np.repeat(np.arange(len(asked)), n)
                v = v.ravel()
            else:
                i, v = np.nonzero(score + norms[at : at + 256][asked, None] * spread[rows] >= bars[asked, None])
            pairs_q.append(at + asked[i])
            pairs_v.append(rows[v])
        if not pairs_q:
            continue
        i, v = np.concatenate(pairs_q), np.concatenate(pairs_v)
        other = block["row"][v] != queries["row"][i]
        i, v = i[other], v[other]
        s = np.concatenate([exact(x[v[j : j + 65_536]], queries["x"][i[j : j + 65_536]]) for j in range(0, len(i), 65_536)] or [np.zeros(0)])
        top = np.lexsort((block["vec_id"][v], -s, i))
        i, v, s = i[top], v[top], s[top]
        place = np.arange(len(i)) - np.searchsorted(i, i, side="left")
        held = (place < k) & (s >= queries["bar"][i])
        found.append((i[held], v[held], s[held]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def usable(embeddings: DataFrame) -> DataFrame:
    """row (a number of its own), vec_id and embedding of the rows that take part.

    Left out: null ids, null, zero and empty vectors, and vectors that hold a null or non-finite
    component. Rows with equal ids each take part. Vectors of different lengths do too, the
    shorter ones as if they ended in zeros.
    """
    v = F.col("embedding")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kind = "array<float>" if embeddings.schema["embedding"].dataType.elementType == T.FloatType() else "array<double>"
    rows = embeddings.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), v.cast(kind).alias("embedding"))


def stacked(vectors: pd.Series, width: int, dtype: type) -> np.ndarray:
    """The vectors as rows of one array, filled up with zeros."""
    out = np.zeros((len(vectors), width), dtype)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def lay_out(cells: pd.DataFrame, codebooks: list[np.ndarray]) -> Cells:
    """Blocks for cells (c0, c1, n, reach): neighbouring small cells share one, a large one has several."""
    cells = cells.sort_values(["c0", "c1"], ignore_index=True)
    first, blocks, at, room = [], [], -1, 0
    for n in cells["n"]:
        parts = -(-n // BLOCK_VECTORS)
        if parts > 1 or room < n:
            at, room = at + 1, 0 if parts > 1 else BLOCK_VECTORS
        first.append(at)
        blocks.append(parts)
        at, room = (at + parts - 1, 0) if parts > 1 else (at, room - n)
    words = cells[["c0"] if (cells["c1"] < 0).all() else ["c0", "c1"]].to_numpy()
    return Cells(codebooks, words, cells["reach"].to_numpy(), np.array(first, int), np.array(blocks, int))


def search(embeddings: DataFrame, is_query: Column, k: int = 20, max_train: int = MAX_TRAIN, books: int = BOOKS, words: int = WORDS, two_words: int = TWO_WORDS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest of each query row.

    Queries are the usable rows for which is_query holds, candidates all usable rows but the
    query's own. Ties go to the smaller vec_id. With fewer than k candidates all are returned; an
    empty table gives no rows.
    """
    spark = embeddings.sparkSession
    rows = materialize(usable(embeddings), "vectors")
    n, asked = rows.count(), rows.filter(is_query).count()
    if not asked:
        return rows.selectExpr("vec_id as query_id", "1 as rank", "vec_id", "0d as score").limit(0)
    width = rows.agg(F.max(F.size("embedding"))).first()[0]
    dtype = np.float32 if rows.schema["embedding"].dataType.elementType == T.FloatType() else np.float64
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id", "embedding").limit(max_train).toPandas()["embedding"]
    codebooks = train(stacked(sample, width, np.float32), books, words)
    naming = 2 if n >= two_words and books > 1 else 1

    def index(batches):
        for batch in batches:
            x = stacked(batch["embedding"], width, dtype)
            codes, left = encode(x.astype(np.float32), codebooks) if len(x) else (np.zeros((0, books), np.uint8), x)
            coarse = x - sum(codebooks[m][codes[:, m]] for m in range(naming))
            norm = lambda r: np.sqrt((r.astype(np.float64) ** 2).sum(axis=1))
            c1 = codes[:, 1].astype(int) if naming > 1 else np.full(len(x), -1)
            yield pd.DataFrame({"row": batch["row"], "vec_id": batch["vec_id"], "x": [r.tobytes() for r in x], "codes": [r.tobytes() for r in codes], "c0": codes[:, 0].astype(int), "c1": c1, "coarse": norm(coarse), "error": norm(left)})

    spread = rows.repartition(max(1, min(-(-n // BLOCK_VECTORS), 10_000)), "row")
    coded = materialize(spread.mapInPandas(index, "row long, vec_id long, x binary, codes binary, c0 int, c1 int, coarse double, error double"), "codes")
    # at most as many cells as two codebooks have pairs of words
    counted = coded.groupBy("c0", "c1").agg(F.count(F.lit(1)).alias("n"), F.max("coarse").alias("reach")).toPandas()
    cells = lay_out(counted, codebooks)
    placed = counted.sort_values(["c0", "c1"])[["c0", "c1"]].assign(first=cells.first, blocks=cells.blocks)
    placed = spark.createDataFrame(placed.astype("int64"), "c0 int, c1 int, first long, blocks long")
    vectors = coded.join(F.broadcast(placed), ["c0", "c1"]).withColumn("block", F.col("first") + F.pmod(F.xxhash64("row"), F.col("blocks"))).drop("first", "blocks")
    vectors = materialize(vectors, "blocks")
    queries = coded.filter(is_query).select("row", "vec_id", "x")

    def unpack(column: pd.Series, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)

    def visit(asking: DataFrame, first: bool) -> DataFrame:
        """query_row, query_id, row, vec_id, score of the best of each block that a query (row, vec_id, x, bar) visits."""

        def route(batches):
            for batch in batches:
                if not len(batch):
                    continue
                found = cells.route(unpack(batch["x"], dtype).astype(np.float32), None if first else batch["bar"].to_numpy())
                yield batch.iloc[np.repeat(np.arange(len(batch)), [len(b) for b in found])].assign(block=np.concatenate(found).astype(np.int64))

        routed = materialize(asking.mapInPandas(route, "row long, vec_id long, x binary, bar double, block long"), "routes")
        parts = routed.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).alias("parts"))
        left = vectors.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        right = routed.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))

        def find(key, block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            none = pd.DataFrame({"query_row": [], "query_id": [], "row": [], "vec_id": [], "score": []}).astype({c: "int64" for c in ("query_row", "query_id", "row", "vec_id")} | {"score": "float64"})
            if not len(block) or not len(asked):
                return none
            codes = unpack(block["codes"], np.uint8)
            b = {"x": unpack(block["x"], dtype), "codes": codes, "named": codes[:, :naming].astype(int), "cell": block["c0"].to_numpy() * 256 + block["c1"].to_numpy()}
            b |= {c: block[c].to_numpy() for c in ("row", "vec_id", "coarse", "error")}
            q = {"x": unpack(asked["x"], dtype), "row": asked["row"].to_numpy(), "bar": asked["bar"].to_numpy()}
            i, v, s = search_block(b, codebooks, q, k, first)
            return pd.DataFrame({"query_row": q["row"][i], "query_id": asked["vec_id"].to_numpy()[i], "row": b["row"][v], "vec_id": b["vec_id"][v], "score": s})

        met = left.select("block", "part", "row", "vec_id", "x", "codes", "c0", "c1", "coarse", "error").groupBy("block", "part").cogroup(right.groupBy("block", "part"))
        return met.applyInPandas(find, "query_row long, query_id long, row long, vec_id long, score double")

    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    lowest = F.lit(float("-inf"))
    begun = materialize(ranked(visit(queries.withColumn("bar", lowest), True)), "first")
    bars = begun.filter(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").alias("bar"))
    asking = materialize(queries.join(bars, "row", "left").select("row", "vec_id", "x", F.coalesce("bar", lowest).alias("bar")), "bars")
    # what set the bar stays, whether or not its approximate score could reach it
    both = visit(asking, False).unionByName(begun.drop("rank")).dropDuplicates(["query_row", "row"])
    out = materialize(ranked(both).select("query_id", "rank", "vec_id", "score"), "neighbours")
    discard(rows, coded, vectors, begun, asking)
    return out
