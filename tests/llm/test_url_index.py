import re

from akuru.llm import urls


def test_index_equals_running_every_rule(spark):
    hosts = {"example.com"}
    for rule in urls.PATTERN_RULES:
        words = rule.name.split("-")
        hosts |= {f"{s.join(words)}.example.com" for s in ("", "-", "_", ".")} | {"".join(words) + "x.example.com", f"{words[0]}-{''.join(words[1:])}.com", f"{''.join(words[:2])}.{'.'.join(words[2:])}.com"}
    rows = [(k, f"http://{h}{p}") for k, (h, p) in enumerate((h, p) for h in sorted(hosts) for p in ("", "/a/PayDayLoans?q=1", "/x"))]
    got = {r.page_id: (r.verdict, r.pattern) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    for k, url in rows:
        host, slash, path = url.removeprefix("http://").partition("?")[0].partition("/")
        hit = next((r for r in urls.PATTERN_RULES if re.search(r.pattern, f"{host}/{path}".lower())), None)
        assert got[k] == (("block", hit.name) if hit else ("allow", None)), url
    assert got[next(k for k, u in rows if u == "http://cheappills.example.com")] == ("block", "cheap-pills")
