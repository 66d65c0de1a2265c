import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from akuru.llm import queries, toxicity


def corpus(rng, n):
    """Plain words; a fifth of the rows hold seed insults or words of an unknown family."""
    plain = ["".join(rng.choice("abdeghiklmnoprstuvw") for _ in range(rng.randrange(3, 9))) for _ in range(3000)]
    rows = []
    for _ in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 200))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "scum", "zxqua" + rng.choice(plain), "zxqui" + rng.choice(plain)])
        rows.append((" ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy_with_an_unknown_family():
    rng = random.Random(4)
    rows = corpus(rng, 1500)
    model = toxicity.train([t for t, _ in rows[:1000]], [y for _, y in rows[:1000]])
    got = [model.score(t) >= toxicity.THRESHOLD for t, _ in rows[1000:]]
    truth = [bool(y) for _, y in rows[1000:]]
    assert sum(g != t for g, t in zip(got, truth, strict=True)) <= 5
    assert 0 <= model.score("") <= toxicity.THRESHOLD and model.score(None) == model.score("")


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(0)
    y = rng.random(6000) < 0.2
    vote = lambda toxic, clean: rng.random(6000) < np.where(y, toxic, clean)
    good, weak = vote(0.6, 0.003), vote(0.5, 0.04)
    others = [vote(0.5, 0.003) for _ in range(8)]
    post, acc, corr = toxicity.label_model(np.stack([good, weak, good, *others], axis=1).astype(np.float32), 0.2)
    assert ((post > 0.5) == y).mean() > 0.93
    assert acc[0] > 0.97 and acc[0] > acc[1] + 0.01
    assert corr[0, 2] > 0.9 and abs(corr[0, 3]) < 0.2


def test_labels_do_not_reach_the_label_model(monkeypatch):
    """It sees votes and one number."""
    seen = []
    whole = toxicity.label_model
    monkeypatch.setattr(toxicity, "label_model", lambda *a: seen.append(a) or whole(*a))
    rows = corpus(random.Random(1), 300)
    toxicity.train([t for t, _ in rows], [y for _, y in rows])
    ((votes, prior),) = seen
    assert votes.shape[1] > 24 and isinstance(prior, float)  # the seed words and those the rows suggest, a voter each


def test_only_near_copies_are_dropped():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(10)) for _ in range(400)]
    texts = [" ".join(rng.sample(vocabulary, 60)) for _ in range(300)]
    copy = texts[0].split()
    copy[5] = "another"
    rows, labels, bags = toxicity.distinct_rows([*texts, " ".join(copy), texts[1], None, ""], [0] * 304)
    assert rows == [*texts, None, ""]  # texts without words have no key to agree on


def test_held_out_precision_and_recall(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(labels[r.doc_id], r.predicted) for r in queries.op6_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    hit = sum(y and p for y, p in got)
    assert hit >= 0.9 * sum(y for y, _ in got) and hit >= 0.9 * sum(p for _, p in got)


def test_training_rows_are_bounded_and_stable(spark, monkeypatch):
    """Repeated ids, with equal and with other texts, in any order; a bound on rows and one on bytes."""
    rows = [(k % 40, f"text {k % 60} " + "x" * (k % 7)) for k in range(300)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic: seen.append((texts, toxic)))
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        toxicity.fit(docs, labels)
        toxicity.fit(docs, labels, max_train=9)
        toxicity.fit(docs, labels, max_bytes=60)
    assert seen[:3] == seen[3:]
    assert len(seen[1][0]) == 9 and sum(map(len, seen[2][0])) <= 60 < sum(map(len, seen[0][0])) and len(set(seen[0][0])) > 9


def test_whole_query(spark, sf):
    out = queries.op6_toxicity(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert sorted(rows) == sorted(queries.op6_toxicity(spark, sf).collect())


def test_held_out_labels_do_not_count(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(40)], "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(1).alias("toxic")).withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1).otherwise(0))
    assert set(toxicity.fit(docs, labels).weights) == set(toxicity.SEED_WORDS)


@pytest.mark.parametrize("rows", [[], [(None, None), (1, ""), (1, ""), (2, "you idiot"), (3, "fine words " * 30_000)]])
def test_edge_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, model).count() == len(rows)
    kept = toxicity.keep(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == max(0, len(rows) - 1)
