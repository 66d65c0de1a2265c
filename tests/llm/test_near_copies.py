import random

from pyspark.sql import functions as F

import corpus_pipeline
from akuru.llm import simhash


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def edited(rng, words, n):
    out = list(words)
    for k in range(n):
        out[len(words) * k // n + 7] = f"x{rng.getrandbits(60):x}"
    return " ".join(out)


def test_pipeline_stage_drops_planted_near_copies(spark, sf):
    rng = random.Random(3)
    rows, copies, far = [], [], []
    for level, edits in enumerate((1, 3, 5, 10)):  # Jaccard 0.98, 0.94, 0.90, 0.82
        for _ in range(40):
            words = [f"w{rng.getrandbits(40):x}" for _ in range(500)]
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, edited(rng, words, edits))]
            assert 0.8 <= jaccard(rows[-1][1], rows[-2][1]) < 1
            copies.append(len(rows) - 1)
    for _ in range(40):
        words = [f"w{rng.getrandbits(40):x}" for _ in range(500)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, edited(rng, words, 15))]
        assert 0.7 < jaccard(rows[-1][1], rows[-2][1]) < 0.8
        far.append(len(rows) - 1)
    words = [f"w{rng.getrandbits(40):x}" for _ in range(500)]
    group = range(len(rows), len(rows) + 60)  # one large group, all alike at 0.90
    rows += [(d, edited(rng, words, 5) if d > group[0] else " ".join(words)) for d in group]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect()}
    assert kept == {d for d, _ in rows} - set(copies) - set(group[1:])


def test_near_links_equal_all_pairs(spark, sf):
    texts = sorted({r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text and r.text.strip()})
    df = spark.createDataFrame(list(enumerate(texts)), "tid long, text string")
    df = df.withColumn("id", F.col("tid").cast("string"))
    got = {tuple(r) for r in simhash.near_links(df, df.select("tid", simhash.signatures("text").bands.alias("bands")), df.select("tid", "id")).collect()}
    sets = [set(simhash.shingle_hashes(t).tolist()) for t in texts]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])}
    assert want and got == want


def test_large_groups_lose_no_component(spark):
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.getrandbits(40):x}" for _ in range(n)]
    texts = []
    for _ in range(30):  # unlike each other, but for two and two
        words = fresh(300)
        texts += [" ".join(words), edited(rng, words, 2)]
    base = fresh(500)
    texts += [edited(rng, base, n) for n in range(1, 41)]  # ever further from the first
    for _ in range(10):
        words = edited(rng, base, 12).split()
        texts += [" ".join(words), edited(rng, words, 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "tid long, text string").withColumn("id", F.col("tid").cast("string"))
    keyed = df.select("tid", F.array(F.lit(1).cast("long"), F.lit(2).cast("long")).alias("bands"))  # all candidates of all
    links = simhash.near_links(df, keyed, df.select("tid", "id"))
    got = {r.node: r.root for r in simhash.components(links).collect()}
    sets = [set(simhash.shingle_hashes(t).tolist()) for t in texts]
    near = [(i, j) for j in range(len(sets)) for i in range(j) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    assert set(map(tuple, links.collect())) <= set(near)
    top = list(range(len(texts)))
    for _ in texts:
        for i, j in near:
            top[i] = top[j] = min(top[i], top[j])
    assert [got.get(i, i) for i in range(len(texts))] == top


def test_large_groups_are_not_compared_each_with_each(spark, monkeypatch):
    rng = random.Random(7)
    fresh = lambda n: [f"w{rng.getrandbits(40):x}" for _ in range(n)]
    base = fresh(200)
    texts = [" ".join(base[:150] + fresh(50)) for _ in range(200)]  # one long passage, and an end of its own
    for n in (100, 60, 200):  # cut and edited by little and by much, in their hundreds around the limit
        for _ in range(60):
            k = rng.randrange(n * 3 // 10)
            texts.append(edited(rng, base[k // 2 : n - k // 3], rng.randrange(1, 6)))
    texts = sorted(set(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "tid long, text string").withColumn("id", F.col("tid").cast("string"))
    counts, compared = [], simhash._compared

    def counted(pairs, *rest):
        counts.append(pairs.count())
        return compared(pairs, *rest)

    monkeypatch.setattr(simhash, "_compared", counted)
    found = simhash.near_links(df, df.select("tid", F.array(F.lit(1).cast("long")).alias("bands")), df.select("tid", "id"))
    got = {r.node: r.root for r in simhash.components(found).collect()}
    sets = [set(simhash.shingle_hashes(t).tolist()) for t in texts]
    top = list(range(len(texts)))
    for _ in texts:
        before = list(top)
        for j in range(len(sets)):
            for i in range(j):
                if top[i] != top[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                    top[i] = top[j] = min(top[i], top[j])
        if top == before:
            break
    assert 200 < len(set(top)) < len(texts)
    assert [got.get(i, i) for i in range(len(texts))] == top
    assert sum(counts) < 10 * len(texts)
