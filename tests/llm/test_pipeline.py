import re

import pytest

from akuru.llm import toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def plain_quality(rows):
    """ids of rows (doc_id, source, text) that pass, by direct counting."""
    measured, hosts = [], {}
    for d, s, t in rows:
        words = re.findall("[^\x20\x09-\x0d]+", t or "")
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        twice = {g for g in grams if grams.count(g) > 1} if len(set(grams)) < len(grams) else set()
        covered = {i + o for i, g in enumerate(grams) if g in twice for o in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        symbols = sum((t or "").count(c) for c in "#*$%&|<>")
        again = len(lines) - len(set(lines))
        failed = [len(words) < 50, 100 * len(covered) > 50 * len(words), 10 * symbols > len(words), again >= 3 and 10 * again > 3 * len(lines)]
        measured.append((d, s, failed))
        hosts.setdefault(s, []).append(failed)
    shrunk, means = {s: [] for s in hosts}, []
    for k in range(4):
        rates = {s: sum(f[k] for f in fs) / len(fs) for s, fs in hosts.items()}
        mean = sum(rates.values()) / len(rates)
        spread = sum((r - mean) ** 2 for r in rates.values()) / len(rates) - sum(mean * (1 - mean) / len(fs) for fs in hosts.values()) / len(hosts)
        strength = min(max(mean * (1 - mean) / spread - 1, 1), 1e6) if spread > 1e-12 else 1e6
        means.append(mean)
        for s, fs in hosts.items():
            shrunk[s].append(round((sum(f[k] for f in fs) + strength * mean) / (len(fs) + strength), 9))
    out = []
    for d, s, failed in measured:
        host_fails = any(r > 0.3 and r > 2 * m for r, m in zip(shrunk[s], means, strict=True))
        counted = [failed[2] and not shrunk[s][2] < 0.5 * means[2], failed[3] and not shrunk[s][3] < 0.5 * means[3]]
        if not (failed[0] or failed[1] or host_fails or any(counted) or (failed[2] and failed[3])):
            out.append(d)
    return sorted(out)


def near_components(rows):
    """Smallest ids of the components of rows (doc_id, text): fingerprints within 2 bits, or five-word shingles at 0.8 or more."""
    from tests.llm.test_simhash import brute_components, plain_fingerprint

    linked = {d: c for d, _, c in brute_components([(d, plain_fingerprint(t)) for d, t in rows])}
    top = dict(linked)

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    def shingles(text):
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1 if w else 0))}

    sets = [(d, shingles(t)) for d, t in rows]
    for j, (b, y) in enumerate(sets):
        for a, x in sets[:j]:
            if x and y and 10 * len(x & y) >= 8 * len(x | y):
                low, high = sorted((find(a), find(b)))
                top[high] = low
    return {d: find(d) for d, _ in rows}


def test_stages_against_plain_restatements(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    by_name, kept = dict(corpus_pipeline.STAGES), {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "simhash_dedup", "mixing", "packing"]
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        kept[name] = out.collect()
        at = spark.createDataFrame(kept[name], docs.schema)

    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert sorted(r.doc_id for r in kept["toxicity"]) == sorted(r.doc_id for r in docs.collect() if model.score(r.text) < 0.3)
    clean = [d for d, t in labels.items() if not t]
    assert len({r.doc_id for r in kept["toxicity"]} & set(clean)) >= 0.98 * len(clean)
    assert sorted(r.doc_id for r in kept["quality_rules"]) == plain_quality([(r.doc_id, r.source, r.text) for r in kept["toxicity"]])
    want = near_components([(r.doc_id, r.text) for r in kept["quality_rules"]])
    assert sorted(r.doc_id for r in kept["simhash_dedup"]) == sorted(set(want.values()))
    sizes, taken = {}, {}
    for r in kept["simhash_dedup"]:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    for r in kept["mixing"]:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    assert abs(sum(taken.values()) / sum(sizes.values()) - 1.5) < 0.25 and all(taken.get(s, 0) <= 2 * n for s, n in sizes.items())
    pieces = by_name["packing"](spark, at, sf).collect()
    fill = {}
    for r in pieces:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 1024 and sum(fill.values()) > 0.95 * 1024 * len(fill)
    assert sum(r.start == 0 for r in pieces) == len(kept["mixing"])
    assert len(corpus_pipeline.run(spark, sf).collect()) == len(pieces)


def test_edge_rows(spark, sf):
    long = " ".join(f"word{k}" for k in range(60_000))
    rows = [(None, None, None, None, None, "a", None), (1, "", "en", None, 0, "b", 1.5), (2, "words to keep " * 60, None, "s", 5, "c", 2.5), (2, "words to keep " * 60, None, "s", 5, "c", 2.5), (3, long, "en", "s", 7, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string, fp double"  # the last two clash with names of the operators
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf).collect()
