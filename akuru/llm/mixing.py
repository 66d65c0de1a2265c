"""Mixing sources to target weights by capped water-filling, in built-in functions only.

The targets solve t(s) = min(cap(s), level * weight(s)) with sum t = budget. The level comes in
closed form from one ordered pass over the sources, which is what clamping and redistributing
until nothing exceeds its cap converges to. Documents are then taken whole: every document
floor(rate) times, and once more those that come first in a seeded order until the source's
words reach its target. The order's prefix sums are made in two levels (hash buckets, then
rows within a bucket), so a source of any size is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, discard, materialize

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Hex digits of the seeded hash that name a bucket; 3 make 4,096 per source.
BUCKET_DIGITS = 3
#: Tables with a row per source are broadcast up to this number of rows (about 100 bytes each).
BROADCAST_SOURCES = 50_000


def n_words(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")


def targets(sizes: DataFrame, budget: float = 1.5, max_epochs: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """From (src_null, src, source_size), one row per source, add weight, target and rate.

    Only the table of sources passes through one task. Sources of size zero get target zero.
    """
    order = Window.orderBy("src_null", "src")
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", cycle.cast("double")).withColumn("cap", (max_epochs * F.col("source_size")).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "src_null", "src")
    all_rows = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = t.withColumn("total", F.sum("source_size").over(all_rows) * F.lit(float(budget)))
    # the level if all sources before this one in order of cap/weight are full and none from here on
    t = t.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    t = t.withColumn("rank", F.row_number().over(by_ratio))
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("rank"))).over(all_rows)
    t = t.withColumn("first", first).withColumn("fill", F.max(F.when(F.col("rank") == F.col("first"), F.col("level"))).over(all_rows))
    t = t.withColumn("target", F.when(F.col("fill").isNull() | (F.col("rank") < F.col("first")), F.col("cap")).otherwise(F.col("fill") * F.col("weight")))
    return t.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))).select("src_null", "src", "source_size", "weight", "target", "rate")


def keyed(docs: DataFrame, source: str, seed: str) -> DataFrame:
    """docs with _m_null, _m_src (the source), _m_size and _m_h (the seeded order) added."""
    text = F.coalesce(F.col("text"), F.lit(""))
    seeded = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text)
    return docs.withColumns({"_m_null": F.col(source).isNull(), "_m_src": F.coalesce(F.col(source).cast("string"), F.lit("")), "_m_size": n_words(), "_m_h": F.md5(seeded)})


def plan(rows: DataFrame, budget: float = 1.5, max_epochs: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source of keyed() rows: its target and the cut of its seeded order.

    Columns: _m_null, _m_src, source_size, weight, target, rate, cut_bucket, cut_h. Of the rows,
    only those of the one bucket per source in which its cut falls are ordered.
    """
    key = ["_m_null", "_m_src"]
    rows = materialize(rows.select(*key, "_m_size", "_m_h", F.substring("_m_h", 1, BUCKET_DIGITS).alias("_m_bucket")), "mix-sizes")
    by_bucket = materialize(rows.groupBy(*key, "_m_bucket").agg(F.sum("_m_size").alias("b_size")), "mix-buckets")
    sizes = by_bucket.groupBy(F.col("_m_null").alias("src_null"), F.col("_m_src").alias("src")).agg(F.sum("b_size").alias("source_size"))
    goal = materialize(targets(sizes, budget, max_epochs, weights).withColumnsRenamed({"src_null": "_m_null", "src": "_m_src"}), "mix-targets")
    want = F.col("target") - F.floor("rate") * F.col("source_size")
    earlier = Window.partitionBy(*key).orderBy("_m_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_bucket.withColumn("b_start", F.coalesce(F.sum("b_size").over(earlier), F.lit(0)))
    at = starts.join(goal, key).withColumn("want", want).filter("b_start < want and want <= b_start + b_size").select(*key, "_m_bucket", "b_start", "want")
    at = materialize(at, "mix-cuts")
    inside = Window.partitionBy(*key).orderBy("_m_h").rowsBetween(Window.unboundedPreceding, -1)
    cut = rows.join(small(at), [*key, "_m_bucket"]).withColumn("start", F.col("b_start") + F.coalesce(F.sum("_m_size").over(inside), F.lit(0)))
    cut = cut.groupBy(*key, F.col("_m_bucket").alias("cut_bucket")).agg(F.max(F.when(F.col("start") + F.col("_m_size") / 2 < F.col("want"), F.col("_m_h"))).alias("cut_h"))
    out = materialize(goal.join(small(cut), key, "left"), "mix-plan")
    discard(rows, by_bucket, goal, at)
    return out


def small(df: DataFrame) -> DataFrame:
    """Hint a broadcast of a table with a row per source if it has been counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_SOURCES else df


def with_copies(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Add source_size, target and copies to keyed() rows."""
    out = rows.join(small(planned), ["_m_null", "_m_src"])
    bucket = F.substring("_m_h", 1, BUCKET_DIGITS)
    extra = (bucket < F.col("cut_bucket")) | ((bucket == F.col("cut_bucket")) & (F.col("_m_h") <= F.col("cut_h")))
    return out.withColumn("copies", (F.floor("rate") + F.when(extra, 1).otherwise(0)).cast("int"))


def mix(docs: DataFrame, source: str = "source", seed: str = "mix", budget: float = 1.5, max_epochs: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (int) and taken of each row of docs.

    A null text has size 0, a null source is the last source, null and repeated ids are rows
    like any other; rows that agree in id and text are taken equally often. copies never exceeds
    max_epochs. The words taken from a source differ from its target by at most half the
    document at which the seeded order is cut. An empty table gives no rows.
    """
    rows = keyed(docs.select("doc_id", F.col(source).alias("source"), "text"), "source", seed).drop("text")
    rows = materialize(rows, "mix-rows")
    out = with_copies(rows, plan(rows, budget, max_epochs, weights))
    return out.select("doc_id", "source", F.col("_m_size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("_m_size")).alias("taken"))


def repeat(docs: DataFrame, source: str = "source", seed: str = "mix", **options) -> DataFrame:
    """The mix itself: each row of docs as often as mix() takes it, with exactly its own columns."""
    rows = keyed(docs, source, seed)
    out = with_copies(rows, plan(rows, **options)).filter("copies > 0")
    return out.withColumn("_m_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)
