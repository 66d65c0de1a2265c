"""The registered queries of the training-data operators, and their DuckDB restatements."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, html, licenses, mixing, packing, quality, simhash, tokenfile, toxicity, urls
from .common import scratch_path, small_batches, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def tokenizer() -> str:
    """The tokenizer file of the contracts; AKURU_TOKENIZER names another."""
    named = os.environ.get("AKURU_TOKENIZER")
    if named:
        return named
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = packing.cut(docs, tokenizer(), memo=400_000).withColumn("ids_crc32", packing.crc(F.col("ids"))).drop("ids")
    out = packing.pack(pieces, docs.count())
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    with small_batches(spark):  # the room goes to remembered words
        tokenfile.write(table(spark, sf_dir, "documents"), tokenizer(), path)
    return tokenfile.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree source[/language[/folder]]/id of one to three levels; the licences of their statements, own or inherited."""
    i = F.col("doc_id")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.when(i % 3 >= 1, F.coalesce("lang", F.lit("-"))), F.when(i % 3 == 2, F.concat(F.lit("d"), (i % 7).cast("string"))), i.cast("string"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path"))
    return licenses.scan(docs, key="doc_id").select("doc_id", "path", "license", "score", "origin", "licensed_dir")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {f.__name__: f for f in (op1_simhash, op2_quality_rules, op3_html_text, op4_mixing, op5_packing, op6_toxicity, op7_token_output, op8_license_scan, op9_nearest_neighbours, op10_url_filters)}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM g) WHERE n > 1),
c AS (SELECT k, count(DISTINCT i + o) AS n FROM r, range(3) AS t(o) GROUP BY k),
m AS (SELECT d.k, doc_id, source, len(w)::BIGINT AS n_words, length(list_aggregate(w, 'string_agg', ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN c USING (k)),
f AS (SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repeats, 10 * n_symbols > n_words AS symbols, n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines AS lines FROM m),
g4 AS (SELECT k, source, unnest(['short', 'repeats', 'symbols', 'lines']) AS rule, unnest([short, repeats, symbols, lines]) AS failed FROM f),
h AS (SELECT source, rule, count(*) AS n, count(*) FILTER (failed) AS failed FROM g4 GROUP BY source, rule),
p AS (SELECT rule, avg(failed / n) AS mean FROM h GROUP BY rule),
v AS (SELECT rule, any_value(mean) AS mean, var_pop(failed / n) - avg(mean * (1 - mean) / n) AS v FROM h JOIN p USING (rule) GROUP BY rule),
s AS (SELECT rule, mean, CASE WHEN v > 1e-12 THEN least(greatest(mean * (1 - mean) / v - 1, 1.0), 1e6) ELSE 1e6 END AS strength FROM v),
q AS (SELECT source, rule, mean, round((failed + strength * mean) / (n + strength), 9) AS rate FROM h JOIN s USING (rule)),
o AS (SELECT source, bool_or(rate > 0.3 AND rate > 2 * mean) AS bad, bool_or(rule = 'symbols' AND rate < 0.5 * mean) AS fine_symbols, bool_or(rule = 'lines' AND rate < 0.5 * mean) AS fine_lines FROM q GROUP BY source)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed,
    NOT (short OR repeats OR bad OR (symbols AND lines) OR (symbols AND NOT fine_symbols) OR (lines AND NOT fine_lines)) AS kept
FROM f JOIN o ON f.source IS NOT DISTINCT FROM o.source"""

_MIXING = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (ARRAY[5.0, 2.0, 1.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST) AS rank FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
f AS (SELECT min(rank) AS first, arg_min(level, rank) AS fill FROM l WHERE level * weight <= cap),
t AS (SELECT source, source_size, CASE WHEN fill IS NULL OR rank < first THEN cap ELSE fill * weight END AS target FROM l LEFT JOIN f ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
o AS (SELECT d.*, source_size, target, rate, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
x AS (SELECT *, max(CASE WHEN start + size / 2 < target - floor(rate) * source_size THEN h END) OVER (PARTITION BY source) AS cut FROM o)
SELECT doc_id, size, source_size, target, ((floor(rate) + CASE WHEN h <= cut THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM x"""


def _url_sql() -> str:
    rules = ", ".join(f"('{r.name}', '{r.verdict}', '{r.name.partition('/')[0]}', '/{r.name.partition('/')[2]}')" for r in urls.PATH_RULES)
    method = " OR ".join(f"regexp_matches(low, '{r.pattern}')" for r in urls.PATTERN_RULES)
    return rf"""
WITH r(rule, verdict, rhost, rpath) AS (VALUES {rules}),
u AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM u),
m AS (SELECT k, arg_min(struct_pack(rule := rule, verdict := verdict), struct_pack(a := -length(rule), b := rule)) AS best
    FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY k)
SELECT page_id, host, path, best.rule AS rule, CASE WHEN best IS NOT NULL THEN best.verdict WHEN {method} THEN 'block' ELSE 'allow' END AS verdict
FROM (SELECT *, CASE WHEN path = '' THEN host || '/' ELSE host || lower(path) END AS low FROM p) LEFT JOIN m USING (k)"""


def _license_sql() -> str:
    templates = ", ".join(f"({k}, '{spdx}', '{text.replace(chr(39), chr(39) * 2)}')" for k, (spdx, text) in enumerate(licenses.TEMPLATES))
    cut = "string_split(regexp_replace({}, '([.!?])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10))"
    lines = "array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN regexp_matches(x, '[a-z0-9]') THEN x ELSE '' END), chr(10))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lower(coalesce(text, '')) AS text,
    concat_ws('/', coalesce(source, '-'), CASE WHEN doc_id % 3 >= 1 THEN coalesce(lang, '-') END, CASE WHEN doc_id % 3 = 2 THEN 'd' || doc_id % 7 END, doc_id::VARCHAR) AS path FROM documents),
e AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS dir, len(regexp_extract_all(text, '[a-z0-9]+')) AS n FROM d),
tpl(no, spdx, text) AS (VALUES {templates}),
tt AS (SELECT no, spdx, t, count(*) AS tf FROM (SELECT no, spdx, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM tpl) GROUP BY ALL),
df AS (SELECT t, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(text, '[a-z0-9]+'))) AS t FROM d) WHERE t IN (SELECT t FROM tt) GROUP BY t),
c AS (SELECT count(*) AS n FROM d),
idf AS (SELECT v.t, ln((1 + c.n) / (1 + coalesce(df.n, 0))) + 1 AS idf FROM (SELECT DISTINCT t FROM tt) AS v LEFT JOIN df USING (t), c),
tw AS (SELECT no, spdx, t, tf * idf AS w FROM tt JOIN idf USING (t)),
tv AS (SELECT no, spdx, t, w / sqrt(sum(w * w) OVER (PARTITION BY no)) AS w FROM tw),
pg AS (SELECT k, p, g FROM (SELECT k, unnest(q) AS g, generate_subscripts(q, 1) AS p FROM (SELECT k, regexp_split_to_array({lines}, '

+') AS q FROM d)) WHERE contains(g, chr(10))),
un AS (SELECT k, 'line' AS kind, 0 AS p, unnest(l) AS u, generate_subscripts(l, 1) AS i FROM (SELECT k, {cut.format('text')} AS l FROM d)
    UNION ALL SELECT k, 'paragraph', p, unnest(l), generate_subscripts(l, 1) FROM (SELECT k, p, {cut.format("translate(g, chr(10), ' ')")} AS l FROM pg)),
s AS (SELECT k, kind, p, i, unnest(regexp_extract_all(u, '[a-z0-9]+')) AS t FROM un),
sw AS (SELECT k, kind, p, i, t, count(*) AS tf, count(*) * coalesce(any_value(idf), any_value(ln(1 + c.n) + 1)) AS w FROM s LEFT JOIN idf USING (t), c GROUP BY k, kind, p, i, t),
sn AS (SELECT k, kind, p, i, sqrt(sum(w * w)) AS norm, sum(tf) AS words FROM sw GROUP BY k, kind, p, i),
cs AS (SELECT k, kind, p, i, no, spdx, sum(sw.w * tv.w) AS dot FROM sw JOIN tv USING (t) GROUP BY k, kind, p, i, no, spdx),
b AS (SELECT k, kind, p, i, any_value(words) AS words, max(struct_pack(score := round(dot / norm, 6), spdx := spdx)) AS m FROM cs JOIN sn USING (k, kind, p, i) GROUP BY k, kind, p, i),
bk AS (SELECT k, kind, max(m) AS m, sum(words) AS words FROM b WHERE m.score >= {licenses.THRESHOLD} GROUP BY k, kind),
own AS (SELECT k, max(m) AS m, max(words) AS words FROM bk GROUP BY k),
o AS (SELECT e.*, own.m, 2 * own.words >= e.n AS whole FROM e LEFT JOIN own USING (k)),
w AS (SELECT dir, max(m) AS m FROM o WHERE whole GROUP BY dir),
up AS (SELECT dir, depth, array_to_string(parts[1:depth], '/') AS above FROM (SELECT dir, parts, unnest(range(0, len(parts) + 1)) AS depth FROM (SELECT DISTINCT dir, string_split(dir, '/') AS parts FROM o))),
nr AS (SELECT up.dir, arg_max(up.above, depth) AS above, arg_max(w.m, depth) AS m FROM up JOIN w ON w.dir = up.above GROUP BY up.dir)
SELECT doc_id, path, coalesce(o.m.spdx, nr.m.spdx) AS license, coalesce(o.m.score, nr.m.score) AS score,
    CASE WHEN o.m IS NOT NULL THEN 'own' WHEN nr.m IS NOT NULL THEN 'inherited' END AS origin, CASE WHEN o.m IS NULL THEN nr.above END AS licensed_dir
FROM o LEFT JOIN nr USING (dir)"""


ORACLES: dict[str, str] = {"op8_license_scan": _license_sql(), "op2_quality_rules": _QUALITY, "op4_mixing": _MIXING, "op10_url_filters": _url_sql()}
