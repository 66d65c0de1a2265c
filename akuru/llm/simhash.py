"""SimHash near-duplicates: fingerprints, sharded BK-trees and connected components.

Documents are reduced to distinct 64-bit fingerprints first, so any number of exact copies is
one entry. Two fingerprints within the radius agree on all but ``radius`` of ``radius + 3``
bit blocks; every choice of three agreeing blocks is one shard key, and a shard's entries
form one BK-tree in which searches follow only edges within the radius. A pair within the
radius shares at least one shard, so sharding loses no link, and a fingerprint has a bounded
number of neighbours, because entries are distinct. The trees are built where their shard is;
they are not sent to every executor, as that would pass all fingerprints through the driver.

Components come from alternating large-star and small-star rounds over the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches

SEED = 42
#: Words of a shingle, and their Jaccard similarity, from which on two texts are near copies (see near_links).
NEAR_N, NEAR = 5, 0.8
#: Bands of minima, and minima in each: a pair at 0.8 shares no band in 4 of 10,000 cases.
BANDS, ROWS = 20, 5
#: Texts of a band key that are compared each with each; in larger groups each is first compared with two of them.
SMALL_GROUP = 8
#: Rows from which on a fingerprint is sent to its rows instead of gathering them, and how many such are (about 40 bytes each).
HOT_ROWS, BROADCAST_HOT = 20_000, 1_000_000
#: Logarithm of the ratio of sizes within a class (see unresolved).
_CLASS = math.log(1.05)
#: Bytes of shingle hashes that are remembered while candidates are compared.
_MEMO = 4_000_000
#: Bits set in each byte value.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1)


def fingerprint(text: str | None, n: int = 3) -> int:
    """The unsigned 64-bit SimHash of the n-word shingles of a text, repeats included.

    A-Z are lower-cased; fewer than n words make one shingle; no words at all make zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < n else map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in shingles), dtype="<u8")
    total = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 4096):
        total += np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(text: Column, n: int = 3) -> Column:
    """The fingerprint as a signed long; a null text counts as empty."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, n) for t in texts], dtype=np.uint64).view(np.int64))

    return of(text)


class BKTree:
    """A BK-tree over distinct 64-bit integers; children are keyed by their distance to the parent."""

    def __init__(self) -> None:
        self.root: int | None = None
        self.children: dict[int, dict[int, int]] = {}

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = value
            self.children[value] = {}
            return
        at = self.root
        while at != value:
            below = self.children[at]
            distance = (at ^ value).bit_count()
            if distance not in below:
                below[distance] = value
                self.children[value] = {}
                return
            at = below[distance]

    def search(self, value: int, radius: int) -> list[int]:
        """All entries within the radius of value."""
        found, open_ = [], [] if self.root is None else [self.root]
        while open_:
            at = open_.pop()
            distance = (at ^ value).bit_count()
            if distance <= radius:
                found.append(at)
            below = self.children[at]
            if below:
                open_ += [c for d in range(distance - radius, distance + radius + 1) if (c := below.get(d)) is not None]
        return found


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within one shard, as (value, smallest value of its tree)."""
    tree, parent = BKTree(), {v: v for v in values}

    def top(v: int) -> int:
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    for v in values:
        for other in tree.search(v, radius):
            a, b = sorted((top(v), top(other)))
            parent[b] = a
        tree.add(v)
    return [(v, r) for v in values if (r := top(v)) != v]


def blocks(parts: int) -> list[tuple[int, int]]:
    """(first bit, width) of the parts that 64 bits are cut into."""
    edges = [64 * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """From distinct(fp), links (a, b) whose connected components are those of all pairs within the radius."""
    cut = blocks(radius + 3)
    keys = []
    for k, kept in enumerate(combinations(cut, 3)):
        mask = sum(((1 << width) - 1) << first for first, width in kept)
        keys.append(F.struct(F.lit(k).cast("byte").alias("k"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")).alias("v")))
    shards = distinct.select("fp", F.explode(F.array(*keys)).alias("s")).select("s.k", "s.v", "fp")
    shards = shards.repartition("k", "v").sortWithinPartitions("k", "v", "fp")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame({"k": [], "v": [], "fp": []}).astype({"k": "int8", "v": "int64", "fp": "int64"})
        for last, batch in _with_last(batches):
            rows = pd.concat([held, batch]) if len(held) else batch
            k, v, fp = (rows[c].to_numpy() for c in ("k", "v", "fp"))
            starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (v[1:] != v[:-1])]) if len(k) else np.zeros(0, int)
            ends = np.r_[starts[1:], len(k)]
            if not last and len(starts):
                held, starts, ends = rows.iloc[starts[-1] :], starts[:-1], ends[:-1]
            out: list[tuple[int, int]] = []
            many = ends - starts > 1
            for a, b in zip(starts[many], ends[many], strict=True):
                out += shard_links(fp[a:b].view(np.uint64).tolist(), radius)
            pairs = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return shards.mapInPandas(find, "a long, b long").distinct()


def _with_last(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[bool, pd.DataFrame]]:
    """Each batch with whether it is the last one."""
    before = None
    for batch in batches:
        if before is not None:
            yield False, before
        before = batch
    if before is not None:
        yield True, before


def components(edges: DataFrame) -> DataFrame:
    """From links (a, b), one row (node, root) per node that has a link; root is its component's smallest node.

    Each round lets every node point its larger neighbours, then its smaller ones, at the
    smallest it knows. The rounds end when every component is a star, which a sum over the nodes tells without another
    round; their number grows with the logarithm of the components' size. Every round is written to the shared folder.
    A round shuffles the links as seldom as it can, since each shuffle costs the driver a thread, a plan and the records of its tasks.
    """
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while not _stars(edges):
        low = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        large = edges.join(low, F.col("b") == F.col("u"), "left").select("a", F.coalesce("m", "b").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        both = F.array(F.struct(F.col("a").alias("x"), F.col("m").alias("y")), F.struct(F.col("b").alias("x"), F.col("m").alias("y")))
        small = large.join(least, "a").select(F.explode(both).alias("e")).select("e.x", "e.y").filter("x <> y").distinct()
        after = materialize(small.toDF("a", "b"), "links")
        discard(edges)
        edges = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _stars(edges: DataFrame) -> bool:
    """Whether of distinct links (a, b), a above b, no node has two smaller ones, or both a smaller and a larger one."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    nodes = edges.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
    return nodes.filter("up + down > 1 and up > 0").count() == 0


def classes(docs: DataFrame, radius: int = 2, n: int = 3) -> DataFrame:
    """doc_id, fp (signed long), component_id and component_root (a fingerprint) of each row of docs.

    Null and empty texts have fingerprint zero and link like any other; repeated rows stay
    repeated; rows with a null id take part in linking, and a component without any id has a null
    component_id. An empty table gives no rows.
    """
    with small_batches(docs.sparkSession):  # whole texts pass to Python here only
        rows = materialize(docs.select("doc_id", fingerprints(F.col("text"), n).alias("fp")), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = components(links(distinct.select("fp"), radius))
    known = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id", "n")
    names = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = materialize(known.join(names, "root").select("fp", "root", "component_id", "n"), "classes")
    discard(distinct)
    # a fingerprint of many rows is sent to them; there are at most a HOT_ROWS-th as many as rows
    hot = known.filter(F.col("n") > HOT_ROWS)
    if 0 < hot.count() <= BROADCAST_HOT:
        hot = F.broadcast(hot)
        named = rows.join(hot.select("fp"), "fp", "left_anti").join(known.filter(F.col("n") <= HOT_ROWS), "fp").unionByName(rows.join(hot, "fp"))
    else:
        named = rows.join(known, "fp")
    return named.select("doc_id", "fp", "component_id", F.col("root").alias("component_root"))


def shingle_hashes(text: str | None, n: int = NEAR_N) -> np.ndarray:
    """The distinct hashes of a text's n-word shingles, words as in fingerprint(); empty without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    shingles = [b" ".join(words)] if 0 < len(words) < n else map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in shingles), dtype=np.uint64))


class Bands:
    """Keys of a text, one per band: equal ones mean equal minima of its permuted shingle hashes."""

    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        self.factor, self.shift = (rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
        self.factor |= np.uint64(1)

    def __call__(self, text: str | None) -> np.ndarray | None:
        """None without words."""
        hashes = shingle_hashes(text)
        if not len(hashes):
            return None
        least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
        for k in range(0, len(hashes), 1024):
            least = np.minimum(least, (hashes[k : k + 1024, None] * self.factor + self.shift).min(axis=0))
        return np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in least.reshape(BANDS, ROWS)], dtype=np.uint64).view(np.int64)


def signatures(text: Column, n: int = 3) -> Column:
    """struct(fp, bands): the fingerprint as a signed long, and a key per band. A text passes to a Python worker once for both."""

    @F.pandas_udf("fp long, bands array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        keys = Bands()
        for texts in batches:
            fps = np.array([fingerprint(t, n) for t in texts], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"fp": fps, "bands": pd.Series([keys(t) for t in texts], dtype="object")})

    return of(text)


def near_links(texts: DataFrame, keyed: DataFrame, firsts: DataFrame) -> DataFrame:
    """Links (a, b) of texts(tid, id, text), which may repeat, whose shingle sets have a Jaccard similarity of NEAR or more.

    firsts(tid, id) names a row of each text; keyed(tid, bands) names the candidates: texts that share a band. In a group of at most
    SMALL_GROUP every pair is compared; in a larger one first every text with two that a hash
    chooses anew in each band, then with four of the most central that are still in other components, and
    then every pair that is left in different components and has shingles enough in common to be near (see unresolved).
    So the links' components are those of all candidates. Every pair is compared by its whole shingle sets.
    """
    rows = materialize(keyed.select("tid", F.posexplode("bands").alias("band", "key")), "bands")
    ends = [f(F.struct(F.xxhash64("tid", "band").alias("h"), "tid")) for f in (F.min, F.max)]
    groups = materialize(rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.array(*(e["tid"] for e in ends))).alias("chosen")).filter("n > 1"), "groups")
    few = rows.join(groups.filter(F.col("n") <= SMALL_GROUP).select("band", "key"), ["band", "key"])
    each = few.select("band", "key", F.col("tid").alias("a")).join(few.select("band", "key", F.col("tid").alias("b")), ["band", "key"]).filter("a < b").select("a", "b")
    large = groups.filter(F.col("n") > SMALL_GROUP).select("band", "key", "chosen")
    number = large.count()
    large = F.broadcast(large) if number <= 50_000 else large
    members = rows.join(large, ["band", "key"])
    some = members.select("tid", F.explode("chosen").alias("c")).filter("tid <> c").select(F.least("tid", "c").alias("a"), F.greatest("tid", "c").alias("b"))
    scored = materialize(_compared(each.union(some).distinct(), texts, firsts), "compared")
    near = F.col("j") >= NEAR
    links = scored.filter(near).select("a", "b")
    if not number:
        return links
    named = members.join(components(links).withColumnRenamed("node", "tid"), "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    held = materialize(_open(named), "open")
    if held.isEmpty():
        return links
    more = materialize(_compared(central(held, scored), texts, firsts).filter(near).select("a", "b"), "near")
    links = links.union(more)
    if not more.isEmpty():
        of = held.select("tid", "root").distinct()
        joined = more.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        moved = components(joined).toDF("root", "to")
        held = materialize(_open(held.join(moved, "root", "left").withColumn("root", F.coalesce("to", "root")).drop("to")), "open")
    return links.union(_compared(unresolved(held, texts, firsts), texts, firsts).filter(near).select("a", "b"))


def _open(named: DataFrame) -> DataFrame:
    """Of named(band, key, tid, root, ...) the groups that lie in several components, with the root of the largest part as main."""
    group = ["band", "key"]
    parts = named.groupBy(*group, "root").agg(F.count(F.lit(1)).alias("n"))
    open_ = parts.groupBy(*group).agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").drop("parts")
    return named.drop("main").join(open_, group)


def central(members: DataFrame, scored: DataFrame) -> DataFrame:
    """Pairs (a, b) of members(band, key, tid, chosen, root) with the most central ones of their groups, where these have another root.

    scored(a, b, j) has the similarity of each member to the chosen ones of its group. Of each quarter of a group, by a hash,
    the member nearest to them all is taken: the less a copy has been changed, the more others are near it.
    """
    group = ["band", "key"]
    ways = scored.select(F.col("a").alias("tid"), F.col("b").alias("c"), "j").union(scored.select("b", "a", "j"))
    away = F.when(F.col("tid") == F.col("c"), 0.0).otherwise(1 - F.col("j"))
    far = members.select(*group, "tid", "root", F.explode("chosen").alias("c")).join(ways, ["tid", "c"], "left").groupBy(*group, "tid", "root").agg(F.sum(away).alias("d"))
    quarter = F.pmod(F.xxhash64("tid", "band"), F.lit(4))
    least = far.groupBy(*group).agg(*(F.min(F.when(quarter == k, F.struct("d", "tid", "root"))).alias(f"m{k}") for k in range(4)))
    least = least.select(*group, F.explode(F.array_compact(F.array(*(f"m{k}" for k in range(4))))).alias("m")).select(*group, F.col("m.tid").alias("c"), F.col("m.root").alias("c_root"))
    pairs = members.join(least, group).filter("root <> c_root").select(F.least("tid", "c").alias("a"), F.greatest("tid", "c").alias("b")).distinct()
    return pairs.join(scored, ["a", "b"], "left_anti")


def unresolved(members: DataFrame, texts: DataFrame, firsts: DataFrame) -> DataFrame:
    """Pairs (a, b) of members(band, key, tid, root, main) with different roots that could be near; none that is near is left out.

    Two sets of m and n shingles that are near share at least o = NEAR / (1 + NEAR) * (m + n). Shingles are ordered, those that
    only one component has first and frequent ones last; then the first shared one of a near pair has at least o
    shingles from it on in both sets. So a text is met by its first shingles only: the smaller one under those that a
    partner of at least its size leaves, the larger one under those that partners of a class of sizes leave. Copies that have
    been changed too much to be near any other begin with shingles of their own, and meet no one. Of each pair
    one text is outside the largest part of a group; parts are not paired within themselves.
    """
    nodes = members.groupBy("tid").agg(F.first("root").alias("root"), F.max(F.col("root") != F.col("main")).alias("apart"))

    @F.pandas_udf("array<long>")
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in batches:
            yield pd.Series([shingle_hashes(t).view(np.int64) for t in some], dtype="object")

    sets = materialize(_first_texts(nodes, texts, firsts).select("tid", "root", "apart", hashes("text").alias("s")), "shingles")
    each = sets.select("tid", "root", "apart", F.size("s").alias("size"), F.explode("s").alias("h"))
    shared = each.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("h", "n")
    ranked = each.join(shared, "h").groupBy("tid", "root", "apart", "size").agg(F.array_sort(F.collect_list(F.struct("n", "h"))).alias("s"))
    ranked = materialize(ranked, "ranked")

    overlap = lambda m, n: F.ceil(NEAR / (1 + NEAR) * (m + n) - 1e-6)
    size, class_of = F.col("size"), lambda n: F.floor(F.log(n) / _CLASS)
    smallest = F.ceil(NEAR * size - 1e-6)

    def first(df: DataFrame, least: Column) -> DataFrame:
        """The first shingles that have at least `least` from them on, each with how many (rest)."""
        at = F.posexplode(F.slice("s", 1, F.greatest(F.lit(0), F.size("s") - least + 1).cast("int"))).alias("k", "x")
        return df.withColumn("shared", F.size("s")).select("tid", "root", "apart", "size", "class", "shared", at).select("tid", "root", "apart", "size", "class", F.col("x.h").alias("h"), (F.col("shared") - F.col("k")).alias("rest"))

    short = first(ranked.withColumn("class", class_of(size)), overlap(size, size))
    classes = ranked.withColumn("class", F.explode(F.sequence(class_of(smallest), class_of(size))))
    long = first(classes, overlap(size, F.greatest(smallest, F.floor(F.exp(F.col("class") * _CLASS)))))
    long = long.select("h", "class", *(F.col(c).alias(f"l_{c}") for c in ("tid", "root", "apart", "size", "rest")))
    ordered = (size < F.col("l_size")) | ((size == F.col("l_size")) & (F.col("tid") < F.col("l_tid")))
    enough = F.least("rest", "l_rest") >= overlap(size, F.col("l_size"))
    met = short.filter("apart").join(long, ["h", "class"]).filter((F.col("root") != F.col("l_root")) & ordered & enough)
    met = met.unionByName(short.filter("not apart").join(long.filter("l_apart"), ["h", "class"]).filter((F.col("root") != F.col("l_root")) & ordered & enough))
    return met.select(F.least("tid", "l_tid").alias("a"), F.greatest("tid", "l_tid").alias("b")).distinct()


def _first_texts(wanted: DataFrame, texts: DataFrame, firsts: DataFrame) -> DataFrame:
    """wanted(tid, ...) with the text of each."""
    # by text and id, so that the copies of one text don't meet in a task
    return texts.join(wanted.join(firsts, "tid"), ["tid", "id"]).dropDuplicates(["tid"])


def _compared(pairs: DataFrame, texts: DataFrame, firsts: DataFrame) -> DataFrame:
    """pairs(a, b) with j, the Jaccard similarity of their texts' shingle sets."""
    pairs = materialize(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("tid")).distinct()
    held = materialize(_first_texts(wanted, texts, firsts).select("tid", "text"), "near-texts")

    @F.pandas_udf("double")
    def similarity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            memo: dict[str, np.ndarray] = {}
            out, held = [], 0
            for pair in zip(left, right, strict=True):
                for t in pair:
                    if t not in memo:
                        if held >= _MEMO:
                            memo.clear()
                            held = 0
                        memo[t] = shingle_hashes(t)
                        held += memo[t].nbytes
                x, y = (memo[t] if t in memo else shingle_hashes(t) for t in pair)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both / max(len(x) + len(y) - both, 1))
            yield pd.Series(out, dtype="float64")

    both = pairs.join(held.select(F.col("tid").alias("a"), F.col("text").alias("s")), "a").join(held.select(F.col("tid").alias("b"), F.col("text").alias("t")), "b")
    return both.select("a", "b", similarity("s", "t").alias("j"))


def keep_first_near(docs: DataFrame, radius: int = 2, n: int = 3) -> DataFrame:
    """One row of each component of docs, as keep_first(), where near copies (see near_links) link too.

    Texts are known by their 64-bit hash.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("fp").alias("f"), F.sha2(text, 256).alias("t"))
    rows = docs.select("doc_id", "text", F.xxhash64(text).alias("tid"), signatures(F.col("text"), n).alias("s")).select("doc_id", "text", "tid", "s.fp", "s.bands")
    narrow = materialize(rows.select("tid", "fp", "bands", order.alias("o")), "fingerprints")
    texts = materialize(narrow.groupBy("tid").agg(F.min("fp").alias("fp"), F.min("o").alias("o"), F.first("bands").alias("bands")), "texts")
    firsts = materialize(texts.groupBy("fp").agg(F.min("tid").alias("t")), "distinct")
    alike = links(firsts.select("fp"), radius)
    alike = alike.join(firsts.select(F.col("fp").alias("a"), F.col("t").alias("x")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("t").alias("y")), "b").select("x", "y")
    same = texts.join(firsts, "fp").filter("tid <> t").select("tid", "t")
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    first = texts.select("tid", F.coalesce(F.col("o.i").cast("string"), F.lit("null")).alias("id"))
    near = near_links(docs.select(F.xxhash64(text).alias("tid"), named.alias("id"), text.alias("text")), texts.select("tid", "bands"), first)
    roots = components(alike.toDF("a", "b").union(same.toDF("a", "b")).union(near))
    known = texts.join(roots, texts["tid"] == roots["node"], "left").select(F.coalesce("root", "tid").alias("root"), "o")
    return _first_rows(docs, known, narrow.select("o"))


def keep_first(docs: DataFrame, radius: int = 2, n: int = 3) -> DataFrame:
    """One row of each component of docs, with exactly its own columns: the one with the smallest id.

    Rows of a component that share the smallest id are told apart by their text; where those
    agree too, one is kept. A component whose ids are all null keeps the row of its smallest
    fingerprint and text.
    """
    rows = docs.withColumn("_s_fp", fingerprints(F.col("text"), n))
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("_s_fp").alias("f"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("t"))
    narrow = materialize(rows.select("_s_fp", order.alias("o")), "fingerprints")
    distinct = materialize(narrow.groupBy("_s_fp").agg(F.min("o").alias("o")).withColumnRenamed("_s_fp", "fp"), "distinct")
    roots = components(links(distinct.select("fp"), radius))
    known = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(F.coalesce("root", "fp").alias("root"), "o")
    return _first_rows(docs, known, narrow.select("o"))


def _first_rows(docs: DataFrame, known: DataFrame, orders: DataFrame) -> DataFrame:
    """Of docs, a row with the smallest o of each root in known(root, o); orders(o) has every row of docs."""
    repeats = orders.groupBy("o").agg(F.count(F.lit(1)).alias("n"))
    winners = known.groupBy("root").agg(F.min("o").alias("o")).join(repeats, "o")
    winners = materialize(winners.select(F.coalesce(F.col("o.i").cast("string"), F.lit("null")).alias("_s_i"), F.col("o.t").alias("_s_t"), "n"), "winners")
    keyed = docs.withColumn("_s_i", F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).withColumn("_s_t", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    key = ["_s_i", "_s_t"]
    kept = keyed.join(winners.filter("n = 1"), key, "left_semi")
    again = winners.filter("n > 1")
    if not again.isEmpty():
        kept = kept.union(keyed.join(again, key, "left_semi").dropDuplicates(key))
    return kept.select(*docs.columns)
