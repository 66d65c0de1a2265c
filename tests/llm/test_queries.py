import pytest

from akuru.llm import mixing, quality, queries, urls
from tests.oracle import same


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    same(spark, sf, queries.QUERIES[name], queries.ORACLES[name])


DOCS = "doc_id long, text string, source string, n_words string, size string"
ROWS = [(None, None, None, "x", "y"), (1, "", "a", "x", "y"), (2, "one two " * 40_000, "a", "x", "y"), (3, "same text here", None, "x", "y"), (3, "same text here", None, "x", "y"), (4, "a b c " * 9 + "\na b c\n\n", "b", "x", "y")]


@pytest.mark.parametrize("rows", [ROWS, []])
def test_edge_rows_of_quality_and_mixing(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    scored = {(r.doc_id, r.n_words): r for r in quality.score(docs).collect()}
    assert quality.score(docs).count() == len(rows) == mixing.mix(docs).count()
    assert quality.keep(docs).columns == docs.columns == mixing.repeat(docs).columns
    if rows:
        assert scored[2, 80_000].n_repeat_words == 80_000 and scored[4, 30].n_repeat_words == 30 and scored[None, 0].base_failed
        mixed = {r.doc_id: r for r in mixing.mix(docs).collect()}
        assert mixed[2].size == 80_000 and all(r.taken <= 2 * r.size for r in mixed.values())
        assert mixing.repeat(docs).count() == sum(r.copies for r in mixing.mix(docs).collect())


def prose(k):
    return " ".join(f"w{k}x{i}" for i in range(60))


def test_host_verdicts_decide(spark, tmp_path):
    """A host full of symbols loses its clean documents too; on a host with hardly any, a lone failure is forgiven."""
    noise = prose(0) + " #" * 20
    rows = []
    for h in range(12):
        for k in range(200):
            bad = k < 120 if h == 0 else k < 1 if h == 1 else k < 20
            rows.append((len(rows), noise if bad else prose(k), "en", f"h{h}", 0))
    rows.append((len(rows), noise + "\n" + "same line\n" * 90 + "#" * 400, "en", "h1", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    same(spark, str(tmp_path), queries.op2_quality_rules, queries.ORACLES["op2_quality_rules"])
    kept = {r.doc_id for r in quality.score(docs).collect() if r.kept}
    assert not kept & set(range(200))  # 80 documents pass every rule of their own, their host doesn't
    assert {200, 201} <= kept and len(rows) - 1 not in kept
    assert 400 not in kept and set(range(420, 600)) <= kept
    assert sorted(r.doc_id for r in quality.keep(docs).collect()) == sorted(kept)


def test_temporary_deletes_what_it_is_not_told_to_keep(spark):
    import os

    from akuru.llm.common import materialize, temporary

    with temporary(spark) as keep:
        a, b = materialize(spark.range(3), "a"), keep(materialize(spark.range(4), "b"))
    assert b.count() == 4 and not os.path.exists(a._akuru_path.removeprefix("file://")) and os.path.exists(b._akuru_path.removeprefix("file://"))


def test_water_filling_stops_at_the_caps(spark):
    sizes = spark.createDataFrame([(False, "a", 10), (False, "b", 1000), (False, "c", 500), (True, "", 0)], "src_null boolean, src string, source_size long")
    got = {r.src: r for r in mixing.targets(sizes).collect()}
    weights, caps, left = {"a": 5, "b": 2, "c": 1, "": 5}, {"a": 20, "b": 2000, "c": 1000, "": 0}, 1510 * 1.5
    want, open_ = {}, set(weights)
    while True:  # clamp and reshare until nothing is above its cap
        share = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] > caps[s]}
        if not full:
            want |= share
            break
        for s in full:
            want[s] = caps[s]
            left -= caps[s]
        open_ -= full
    assert {s: pytest.approx(w) for s, w in want.items()} == {s: r.target for s, r in got.items()}


def test_urls(spark):
    rows = [(1, "http://A.com/en/7", "x"), (2, "https://example.com/en/7?q=/x", "x"), (3, "https://example.com/en/8#y", "x"), (4, "ftp://de.example.net/de/81", "x"), (5, "x://net/de/", "x"), (6, "no scheme", "x"), (7, None, "x"), (8, "http://notcom/en/1", "x"), (9, "https://www.cheap-pills.org", "x"), (10, "https://cheap-pillsy.org/a", "x"), (11, "http://h.org/es", "x"), (11, "http://h.org/es", "x"), (None, "http://example.org/es/?", "x"), (12, "http://a.org/" + "long/" * 20_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = sorted((r.page_id or 0, r.host, r.path[:9], r.rule, r.verdict) for r in urls.judge(df).collect())
    assert got == [
        (0, "example.org", "/es/", "org/es/", "block"), (1, "a.com", "/en/7", "com/en/", "block"), (2, "example.com", "/en/7", "example.com/en/7", "allow"), (3, "example.com", "/en/8", "com/en/", "block"),
        (4, "de.example.net", "/de/81", "example.net/de/8", "block"), (5, "net", "/de/", "net/de/", "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "notcom", "/en/1", None, "allow"),
        (9, "www.cheap-pills.org", "", None, "block"), (10, "cheap-pillsy.org", "/a", None, "allow"), (11, "h.org", "/es", None, "allow"), (11, "h.org", "/es", None, "allow"), (12, "a.org", "/long/lon", None, "allow"),
    ]
    assert urls.judge(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        urls.judge(df, urls.PATH_RULES * (urls.MAX_RULES // 5 + 1))
