import random

import pytest
from pyspark.sql import functions as F

from akuru.llm import queries, simhash


def brute_components(rows, radius=2):
    """rows: (doc_id, fp unsigned). Smallest id reachable, by trying all pairs."""
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def top(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[top(a)] = top(b)
    first = {}
    for d, f in rows:
        if d is not None:
            first[top(f)] = min(first.get(top(f), d), d)
    return [(d, f, first.get(top(f))) for d, f in rows]


def plain_fingerprint(text):
    import xxhash

    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_bk_tree_finds_what_a_scan_finds():
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    values = {centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) & (2**64 - 1) for _ in range(300)} | {rng.getrandbits(64) for _ in range(300)}
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
        tree.add(v)
    for v in list(values)[:100]:
        assert sorted(tree.search(v, 2)) == sorted(x for x in values if (x ^ v).bit_count() <= 2)


def test_components_of_synthetic_fingerprints(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 30)):  # chains: each step flips up to two bits
            for _ in range(rng.randrange(3)):
                f ^= 1 << rng.randrange(64)
            rows.append((len(rows), f))
    rng.shuffle(rows)
    df = spark.createDataFrame([(d, f - (1 << 64) if f >> 63 else f) for d, f in rows], "doc_id long, fp long")
    edges = simhash.components(simhash.links(df.select("fp").distinct(), 2))
    root = {r.node: r.root for r in edges.collect()}
    want = {}
    for d, f, c in brute_components(rows):
        want.setdefault(c, set()).add(f - (1 << 64) if f >> 63 else f)
    for group in want.values():
        assert len({root.get(f, f) for f in group}) == 1
    assert len({root.get(f, f) for g in want.values() for f in g}) == len(want)


def test_components_of_stars_take_no_round(spark, monkeypatch):
    stored, materialize = [], simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, tag: stored.append(tag) or materialize(df, tag))
    stars = [(1, 5), (6, 1), (9, 1), (3, 4), (4, 3), (-7, 2)]
    got = {tuple(r) for r in simhash.components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {(5, 1), (6, 1), (9, 1), (4, 3), (2, -7)}
    assert stored == ["links"]  # the links themselves: there is nothing to do, and no round to find that out


def test_components_of_any_links(spark):
    rng = random.Random(4)
    nodes = [rng.getrandbits(63) - 2**62 for _ in range(300)]
    pairs = [tuple(rng.sample(nodes, 2)) for _ in range(170)] + [(x, y) for x, y in zip(nodes[:60], nodes[1:60], strict=False)] + [(nodes[70], n) for n in nodes[71:110]] + [(nodes[0], nodes[0])]
    top = {n: n for p in pairs for n in p}
    for _ in nodes:
        for a, b in pairs:
            top[a] = top[b] = min(top[a], top[b])
    got = [tuple(r) for r in simhash.components(spark.createDataFrame(pairs * 2, "a long, b long")).collect()]
    assert sorted(got) == sorted((n, r) for n, r in top.items() if n != r)


def test_whole_query_equals_brute_force(spark, sf):
    got = {(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in queries.op1_simhash(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got == set(brute_components([(r.doc_id, plain_fingerprint(r.text)) for r in docs]))


def test_nulls_empty_long_and_repeated_rows(spark):
    long_text = "word other third " * 20_000
    rows = [(1, None), (2, ""), (None, " \n"), (3, "One  two"), (3, "one two"), (4, long_text), (9, long_text + "x"), (None, "alone here now"), (5, None), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = simhash.classes(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.fp, r.component_id))
    assert by[1] == {(0, 1)} and by[2] == {(0, 1)} and by[5] == {(0, 1)}
    assert {c for _, c in by[3]} == {3} and {c for _, c in by[9]} == {4}
    assert by[None] == {(0, 1), next(x for x in by[None] if x[0])}
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1, r.text[:5]) if r.text else (r.doc_id, r.text) for r in kept.collect() if r.doc_id != 1) == sorted([(-1, "alone"), (3, kept.filter("doc_id = 3").first().text[:5]), (4, "word ")])
    assert [r.text for r in kept.filter("doc_id = 1").collect()] == [None]


@pytest.mark.parametrize("rows", [[], [(None, None)]])
def test_small_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.classes(df).count() == len(rows)
    assert simhash.keep_first(df).count() == len(rows)


def test_fingerprints_of_many_rows_are_sent_to_them(spark, monkeypatch):
    rows = [(d, "one text that many rows share") for d in range(40)] + [(None, None)] * 30 + [(100 + d, f"text {d} of its own") for d in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(map(repr, simhash.classes(docs).collect()))
    for few, hot in ((20, 10), (20, 0)):  # two fingerprints are hot; with no room for them all rows are joined by a shuffle
        monkeypatch.setattr(simhash, "HOT_ROWS", few)
        monkeypatch.setattr(simhash, "BROADCAST_HOT", hot)
        assert sorted(map(repr, simhash.classes(docs).collect())) == plain and len(plain) == len(rows)


def test_whole_texts_pass_to_python_in_small_batches(spark, monkeypatch):
    key, held, materialize = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, simhash.materialize
    before = spark.conf.get(key)
    monkeypatch.setattr(simhash, "materialize", lambda df, tag: held.setdefault(tag, spark.conf.get(key)) and materialize(df, tag))
    docs = spark.createDataFrame([(d, f"text {d % 3} of three") for d in range(2500)], "doc_id long, text string")
    assert {r.component_id for r in simhash.classes(docs).collect()} <= {0, 1, 2}
    assert int(held["fingerprints"]) <= 1000 and held["distinct"] == before == spark.conf.get(key)
