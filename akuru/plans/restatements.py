"""The queries of the catalogue in DuckDB's SQL."""

from __future__ import annotations

from ..functions import script as S
from ..operators.corpus import CLEAN_MARKUP
from ..operators.evaluation import PLAIN_FILI
from ..operators.export import replacement_pairs
from ..operators.grammar import EVE, EVE_ENDING, INFORMAL, MESSAGE, PUNCTUATION
from ..operators.morphology import LONGEST, RULES
from ..operators.spelling import SUFFIXES

q = S.quoted
TZ = S.THAANA + S.ZERO_WIDTH
_values = lambda rows: ", ".join("(" + ", ".join(q(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def _by_chunks(text: str) -> str:
    """Transliteration without the chain of replacements: the text in chunks, each written by the chunks around it."""
    both = lambda s: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s)
    consonants = {**S.DIGRAPHS, **S.SINGLES, "x": "ކް" + S.SINGLES["s"]}
    long_first = lambda names: "|".join(both(n) for n in sorted(names, key=lambda n: (-len(n), n)))
    cut = f"{both('n')}'|{long_first(consonants)}|{long_first(S.VOWELS)}|(?s:.)"
    # x[1] the chunk, x[2] the one before, x[3] the one after
    small = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    is_in = lambda x, names: f"{small(x)} IN ({', '.join(q(n) for n in names)})"
    letter = "CASE " + " ".join(f"WHEN {small('x[1]')} = '{n}' THEN {q(c)}" for n, c in consonants.items() if n != "h") + f" WHEN regexp_matches(x[3], '^\\p{{L}}') THEN '{S.SINGLES['h']}' ELSE '{S.DIGRAPHS['sh']}' END"
    sign = "CASE " + " ".join(f"WHEN {small('x[1]')} = '{n}' THEN {q(c)}" for n, c in S.VOWELS.items()) + " END"
    bare = q("n'")
    each = f"""CASE WHEN {small('x[1]')} = {bare} THEN '{S.NOONU}'
        WHEN {is_in('x[1]', consonants)} THEN {letter} || CASE WHEN {is_in('x[3]', S.VOWELS)} THEN '' ELSE '{S.SUKUN}' END
        WHEN {is_in('x[1]', S.VOWELS)} THEN CASE WHEN {is_in('x[2]', consonants)} THEN '' ELSE '{S.ALIFU}' END || {sign} ELSE x[1] END"""
    return f"(SELECT coalesce(array_to_string(list_transform(list_zip(c, list_concat([''], c[1:len(c) - 1]), list_concat(c[2:], [''])), lambda x: {each}), ''), '') FROM (SELECT regexp_extract_all({text}, {q(cut)}) AS c))"


D = f"d AS (SELECT doc_id, {S.latin_to_thaana_sql("coalesce(text, '')")} AS t FROM documents)"
TALK = f"k AS (SELECT conv_id, turn, {S.latin_to_thaana_sql("coalesce(text, '')")} AS t FROM conversations)"
WORDS = f"{D}, dw AS (SELECT doc_id, {S.words_sql('t')} AS w FROM d), u AS (SELECT word, count(*) AS cnt FROM (SELECT unnest(w) AS word FROM dw) GROUP BY word)"
LEX = f"{WORDS}, lex AS (SELECT word, least(cnt, 100000)::BIGINT AS freq FROM u WHERE cnt >= 3 AND length(word) >= 2 AND {S.is_well_formed_sql('word')})"
BI = "bi AS (SELECT w[i] AS w1, w[i + 1] AS w2, count(*) AS cnt FROM (SELECT w, unnest(range(1, len(w))) AS i FROM dw) GROUP BY ALL)"
BI3 = f"{BI}, b3 AS (SELECT * FROM bi WHERE cnt >= 3)"
TALKW = f"{TALK}, kw AS (SELECT conv_id, turn, {S.words_sql('t')} AS w FROM k), ku AS (SELECT word, count(*) AS cnt FROM (SELECT unnest(w) AS word FROM kw) GROUP BY word)"
RULE = f"rules(kind, rule_no, remove, append) AS (VALUES {_values(RULES)})"


def _tokens(source: str, keys: str) -> str:
    """Rows keys, pos, word, start, end of a relation with keys and t."""
    return f"""
SELECT {keys}, (row_number() OVER (PARTITION BY {keys} ORDER BY k) - 1)::INT AS pos, word, (e - length(run))::INT AS start, e::INT AS "end" FROM (
    SELECT *, translate(run, '{S.ZERO_WIDTH}', '') AS word, sum(length(run)) OVER (PARTITION BY {keys} ORDER BY k) AS e FROM (
        SELECT {keys}, unnest(r) AS run, generate_subscripts(r, 1) AS k FROM (SELECT {keys}, regexp_extract_all(t, '[{TZ}]+|[^{TZ}]+') AS r FROM {source})))
WHERE regexp_matches(run, '^[{TZ}]') AND word <> ''"""


def _cover(source: str, pattern: str) -> str:
    return f"""(SELECT doc_id, chunk, (e - length(chunk))::INT AS s, e::INT AS e FROM (SELECT *, sum(length(chunk)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM (
    SELECT doc_id, unnest(r) AS chunk, generate_subscripts(r, 1) AS k FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS r FROM {source}))))"""


_with_eve = lambda w: f"CASE WHEN ends_with({w}, '{S.SUKUN}') OR ends_with({w}, 'އި') THEN left({w}, length({w}) - 1) || '{EVE_ENDING}' ELSE {w} || '{EVE}' END"
_formal = lambda w: f"CASE WHEN ends_with({w}, '{EVE_ENDING}') THEN {w} ELSE {_with_eve(w)} END"
_informal = lambda w: "CASE " + " ".join(f"WHEN ends_with({w}, '{a}') AND length({w}) > {len(a) + 1} THEN left({w}, length({w}) - {len(a)}) || '{b}'" for a, b in INFORMAL) + f" ELSE {w} END"
_RUN = f"regexp_extract(s, '([{TZ}]*[{S.THAANA}][{TZ}]*)(?:[^{TZ}]+[{S.ZERO_WIDTH}]*)*$', 1)"
_TAIL = f"regexp_extract(s, '(?:[^{TZ}]+[{S.ZERO_WIDTH}]*)*$')"


def _convert(source: str, fn) -> str:
    new = fn(f"translate({_RUN}, '{S.ZERO_WIDTH}', '')")
    one = f"CASE WHEN {_RUN} = '' THEN s ELSE left(s, length(s) - length({_TAIL}) - length({_RUN})) || {new} || {_TAIL} END"
    return f"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(t, '[^.!؟\\n]+[.!؟]?\\n?|[.!؟\\n]'), lambda s: {one}), '') AS t FROM {source}"


M = f"""{D}, m1 AS (SELECT doc_id, replace(t, '. ', ' .  ') AS t FROM d),
m2 AS (SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN replace(t, ',', '?') WHEN 2 THEN replace(t, ',', ' ;') ELSE t END AS t FROM m1),
m3 AS (SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN replace(t, 'ް .', 'ެވެ .') ELSE t END AS t FROM m2),
m AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN replace(t, 'ން ', 'ން {EVE} ') ELSE t END AS t FROM m3)"""
_ALL = f"[{PUNCTUATION}]"
_TOK = f"tk AS ({_tokens('m', 'doc_id')}), pr AS (SELECT * FROM (SELECT *, lag(word) OVER w AS p_word, lag(start) OVER w AS p_start, lag(\"end\") OVER w AS p_end FROM tk WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) JOIN m USING (doc_id) WHERE p_word IS NOT NULL AND regexp_matches(substring(t, p_end + 1, start - p_end), '^[{S.WIDE_SPACE}]*$'))"
_SENT = f"""sn AS (SELECT doc_id, n, w[-1] AS last, fs AS first_start, le - length(lr) AS last_start, le AS last_end, ends_with(w[-1], '{EVE_ENDING}') AS formal FROM (
    SELECT doc_id, len(w) AS n, w, s + length(regexp_extract(chunk, '^[^{TZ}]*')) AS fs, e - length(regexp_extract(chunk, '[^{TZ}]*$')) AS le, regexp_extract(chunk, '([{TZ}]+)[^{TZ}]*$', 1) AS lr
    FROM (SELECT *, {S.words_sql('chunk')} AS w FROM {_cover('m', '[^.!؟\\n]+[.!؟]?|[.!؟\\n]')}) WHERE len(w) > 0))"""
GRAMMAR = {
    "punctuation": (M, f"""SELECT doc_id, CASE right(chunk, 1) WHEN ',' THEN 'thaana-comma' WHEN '?' THEN 'thaana-question' ELSE 'thaana-semicolon' END AS rule, s + 1 AS start, e AS "end", translate(right(chunk, 1), ',?;', '،؟؛') AS replacement
        FROM {_cover('m', f'[{S.THAANA}] *[,?;]|[^{S.THAANA}]+|[{S.THAANA}]')} WHERE regexp_matches(chunk, '^[{S.THAANA}] *[,?;]$')"""),
    "space_before": (M, f"""SELECT doc_id, 'space-before-punct' AS rule, s AS start, e AS "end", right(chunk, 1) AS replacement FROM {_cover('m', f' +{_ALL}|[^ ]+| +')} WHERE regexp_matches(chunk, '^ +{_ALL}$')"""),
    "space_after": (M, f"""SELECT doc_id, 'space-after-punct' AS rule, s AS start, s + 1 AS "end", left(chunk, 1) || ' ' AS replacement FROM {_cover('m', f'{_ALL}[{S.THAANA}]|{_ALL}|[^{PUNCTUATION}]+')} WHERE regexp_matches(chunk, '^{_ALL}[{S.THAANA}]$')"""),
    "double_space": (M, f"""SELECT doc_id, 'double-space' AS rule, s AS start, e AS "end", ' ' AS replacement FROM {_cover('m', ' +|[^ ]+')} WHERE regexp_matches(chunk, '^  +$')"""),
    "repeated_words": (f"{M}, {_TOK}", """SELECT doc_id, 'repeated-word' AS rule, p_start AS start, "end", p_word AS replacement FROM pr WHERE word = p_word"""),
    "detached_eve": (f"{M}, {_TOK}", f"""SELECT doc_id, 'detached-eve' AS rule, p_start AS start, "end", {_with_eve('p_word')} AS replacement FROM pr WHERE word = '{EVE}' AND p_word <> '{EVE}'"""),
    "long_sentences": (f"{M}, {_SENT}", """SELECT doc_id, 'long-sentence' AS rule, first_start::INT AS start, last_end::INT AS "end", NULL::VARCHAR AS replacement FROM sn WHERE n > 40"""),
    "formal_register": (f"{M}, {_SENT}", """SELECT doc_id, 'formal-register' AS rule, last_start::INT AS start, last_end::INT AS "end", NULL::VARCHAR AS replacement FROM (
        SELECT *, count(*) OVER p AS c, sum(formal::INT) OVER p AS f FROM sn WHERE n >= 3 WINDOW p AS (PARTITION BY doc_id)) WHERE c >= 3 AND f / c >= 0.6 AND NOT formal"""),
}
_SEV = "CASE WHEN rule IN ('space-after-punct', 'repeated-word') THEN 'warning' WHEN rule IN ('double-space', 'long-sentence', 'formal-register') THEN 'style' ELSE 'error' END"
_MSG = "CASE rule " + " ".join(f"WHEN {q(r)} THEN {q(m)}" for r, m in MESSAGE.items()) + " END"
_ISSUES = " UNION ALL ".join(f"SELECT *, {k} AS ord FROM ({body})" for k, (_, body) in enumerate(GRAMMAR.values()))

DEFS = f"""pt AS (SELECT p_partkey, {S.latin_to_thaana_sql('lower(p_name)')} AS head, {S.latin_to_thaana_sql('lower(p_type)')} AS a, {S.latin_to_thaana_sql('lower(p_brand)')} AS b FROM part),
df AS (SELECT head, p_partkey * 2 AS sense_no, a AS sense FROM pt UNION ALL SELECT head, p_partkey * 2 + 1, b FROM pt)"""
INDEX = f"ix AS (SELECT DISTINCT term, head FROM (SELECT head, unnest({S.words_sql('sense')}) AS term FROM df) WHERE length(term) >= 2)"
SYN = f"""sy0 AS (SELECT w1 AS word, w2 AS syn FROM b3 WHERE w1 <> w2 AND length(w1) >= 2 AND length(w2) >= 2 AND {S.is_well_formed_sql('w1')} AND {S.is_well_formed_sql('w2')}),
sy AS (SELECT word, syn FROM sy0 UNION SELECT syn, word FROM sy0)"""
THES = f"{WORDS}, {BI3}, {SYN}, th AS (SELECT sy.word, row_number() OVER (PARTITION BY sy.word ORDER BY syn)::INT AS ord, syn, coalesce(u.cnt, 0) AS cnt FROM sy LEFT JOIN u ON u.word = sy.syn)"
ALT = lambda least: f"al AS (SELECT word, list(syn ORDER BY cnt DESC, ord) AS choices FROM th WHERE cnt >= {least} GROUP BY word)"


def _invert(source: str, column: str, kinds: str, more: str = "") -> str:
    """Rows word, kind, rule_no, stem."""
    stem = "left(x, length(x) - length(append)) || remove"
    return f"SELECT word, kind, rule_no, {stem} AS stem FROM (SELECT *, right(x, n) AS tail FROM (SELECT word, {column} AS x, unnest(range(1, least(length({column}), {LONGEST}) + 1)) AS n FROM {source})) JOIN rules ON tail = append AND kind IN ({kinds}) WHERE length({stem}) >= 2 AND {stem} <> x"


def _analyze(source: str) -> str:
    return f"""i1 AS ({_invert(source, 'word', "'nominal', 'verb', 'eve'")}), i2 AS ({_invert("(SELECT * FROM i1 WHERE kind = 'eve')", 'stem', "'nominal', 'verb'")}),
an AS (SELECT word, stem, min(struct_pack(p := p, r := rule_no)) AS o FROM (
    SELECT word, stem, rule_no, CASE kind WHEN 'nominal' THEN 1 WHEN 'verb' THEN 2 ELSE 3 END AS p FROM i1 UNION ALL SELECT word, stem, rule_no, CASE kind WHEN 'nominal' THEN 4 ELSE 5 END FROM i2)
    WHERE stem IN (SELECT word FROM lex) GROUP BY word, stem),
ranked AS (SELECT word, stem, row_number() OVER (PARTITION BY word ORDER BY o.p, o.r, stem)::INT AS rank FROM an)"""


def _generate(kinds: str) -> str:
    return f"SELECT DISTINCT word AS stem, left(word, length(word) - length(remove)) || append AS form FROM lex JOIN rules ON ends_with(word, remove) WHERE kind IN ({kinds}) AND length(word) > length(remove) AND left(word, length(word) - length(remove)) || append <> word"


STATUS = f"""{RULE}, f AS (SELECT word, len({S.structure_errors_sql('word')}) > 0 AS bad FROM ku WHERE word NOT IN (SELECT word FROM lex)), g AS (SELECT word FROM f WHERE NOT bad), {_analyze('g')},
sf(ord, suffix) AS (VALUES {_values(list(enumerate(SUFFIXES)))}),
sc AS (SELECT word, ord, left(word, length(word) - length(suffix)) AS stem FROM g JOIN sf ON ends_with(word, suffix) WHERE length(word) - length(suffix) >= 2),
st AS (SELECT word, ord, 0 AS t, stem AS via FROM sc UNION ALL SELECT word, ord, 1, left(stem, length(stem) - 1) || '{S.SUKUN}' FROM sc WHERE ends_with(stem, 'ު')
    UNION ALL SELECT word, ord, 2, stem || '{S.SUKUN}' FROM sc WHERE {S.structure_errors_sql('stem')}[-1].code = 'missing-fili'),
v2 AS (SELECT word, arg_min(via, struct_pack(ord := ord, t := t)) AS via FROM st WHERE via IN (SELECT word FROM lex) GROUP BY word),
cp AS (SELECT word, i, array_to_string(c[1:i], '') AS l, array_to_string(c[i + 1:], '') AS r FROM (SELECT word, c, unnest(range(2, len(c) - 1)) AS i FROM (SELECT word, {S.chunks_sql('word')} AS c FROM g) WHERE len(c) >= 5)),
v3 AS (SELECT word, arg_min(l || ' + ' || r, i) AS via FROM cp WHERE l IN (SELECT word FROM lex) AND r IN (SELECT word FROM lex) GROUP BY word),
ws AS (SELECT word, CASE WHEN lex.word IS NOT NULL THEN 'ok' WHEN bad THEN 'structure' WHEN coalesce(ranked.stem, v2.via, v3.via) IS NOT NULL THEN 'ok-derived' ELSE 'unknown' END AS status, coalesce(ranked.stem, v2.via, v3.via) AS via
    FROM ku LEFT JOIN lex USING (word) LEFT JOIN f USING (word) LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) AS ranked USING (word) LEFT JOIN v2 USING (word) LEFT JOIN v3 USING (word))"""

_DEL = f"""(SELECT word, array_to_string(list_filter(k, lambda x, j: j NOT IN (a, b)), '') AS dk FROM (SELECT word, k, unnest(range(0, len(k) + 1)) AS a FROM {{source}}), range(0, 99) AS r(b)
    WHERE b <= len(k) AND (a = 0 AND b = 0 OR a = 0 AND b > 0 OR a > 0 AND b > a AND len(k) > 2))"""
_deletes1 = lambda source: "SELECT DISTINCT dk, word FROM " + _DEL.replace("{source}", f"(SELECT word, {S.unit_keys_sql('word')} AS k FROM {source})").replace("a > 0 AND b > a AND len(k) > 2", "false")
_deletes = lambda source: "SELECT DISTINCT dk, word FROM " + _DEL.replace("{source}", f"(SELECT word, {S.unit_keys_sql('word')} AS k FROM {source})")

_like = " ".join(f"WHEN '{ch}' THEN [{', '.join(q(x) for x in g if x != ch)}]" for g in S.CONFUSION_SETS for ch in g)
CORRUPT = f"""pool AS (SELECT word, {S.chunks_sql('word')} AS c FROM lex WHERE freq >= 3 AND len({S.chunks_sql('word')}) >= 3),
att AS (SELECT word, c, i, c[i] AS u FROM (SELECT word, c, unnest(range(1, len(c) + 1)) AS i FROM pool)),
cr AS (SELECT word, 'fili-swap' AS kind, array_to_string(c[1:i - 1], '') || left(u, 1) || f || array_to_string(c[i + 1:], '') AS wrong FROM att, (SELECT unnest(string_split('{PLAIN_FILI}', '')) AS f) WHERE length(u) = 2 AND right(u, 1) NOT IN (f, '{S.SUKUN}')
UNION SELECT word, 'confusion', array_to_string(c[1:i - 1], '') || x || substring(u, 2) || array_to_string(c[i + 1:], '') FROM (SELECT *, unnest(CASE left(u, 1) {_like} END) AS x FROM att)
UNION SELECT word, 'delete-unit', array_to_string(c[1:i - 1], '') || array_to_string(c[i + 1:], '') FROM att
UNION SELECT word, 'transpose', array_to_string(c[1:i - 1], '') || c[i + 1] || c[i] || array_to_string(c[i + 2:], '') FROM att WHERE i < len(c)
UNION SELECT word, 'drop-sukun', left(word, length(word) - 1) FROM pool WHERE ends_with(word, '{S.SUKUN}'))"""

CONTEXT = f"""tk AS ({_tokens('k', 'conv_id, turn')}),
n AS (SELECT *, lag(word) OVER w AS prev, lead(word) OVER w AS next FROM tk WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos)),
o AS (SELECT n.*, b3.cnt AS c1, c.cnt AS c2 FROM n LEFT JOIN b3 ON w1 = prev AND w2 = word LEFT JOIN b3 AS c ON c.w1 = word AND c.w2 = next WHERE word IN (SELECT word FROM lex)),
sw AS (SELECT *, left(word, i - 1) || translate(substring(word, i, 1), '{''.join(S.LENGTH_MAP)}', '{''.join(S.LENGTH_MAP.values())}') || substring(word, i + 1) AS alt FROM (
    SELECT * EXCLUDE (c1, c2), unnest(range(1, length(word) + 1)) AS i FROM o WHERE coalesce(c1, 0) + coalesce(c2, 0) = 0) WHERE contains('{''.join(S.LENGTH_MAP)}', substring(word, i, 1))),
al AS (SELECT sw.*, coalesce(b3.cnt, 0) + coalesce(c.cnt, 0) AS s FROM sw LEFT JOIN b3 ON b3.w1 = prev AND b3.w2 = alt LEFT JOIN b3 AS c ON c.w1 = alt AND c.w2 = next WHERE alt IN (SELECT word FROM lex)),
bst AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, pos ORDER BY s DESC, i) AS r FROM al WHERE s >= 8)"""

_GROUPS = ("".join(S.CONFUSION_SETS), "".join(chr(0x41 + k) * len(g) for k, g in enumerate(S.CONFUSION_SETS)))
_PAIRS = ("".join(S.LENGTH_MAP), "".join(S.LENGTH_MAP.values()))


def _replace_cost(x: str, y: str) -> str:
    """The cost of unit key x of the query for unit key y."""
    sound = f"CASE WHEN left({x}, 1) = left({y}, 1) THEN 0::DOUBLE WHEN translate(left({x}, 1), '{_GROUPS[0]}', '{_GROUPS[1]}') = translate(left({y}, 1), '{_GROUPS[0]}', '{_GROUPS[1]}') THEN 0.5::DOUBLE ELSE 1::DOUBLE END"
    sign = f"CASE WHEN right({x}, 1) = right({y}, 1) THEN 0::DOUBLE WHEN translate(right({x}, 1), '{_PAIRS[0]}', '{_PAIRS[1]}') = right({y}, 1) OR right({x}, 1) = '{S.SUKUN}' AND right({y}, 1) = '_' THEN 0.4::DOUBLE ELSE 0.7::DOUBLE END"
    return f"least({sound} + {sign}, 1.5::DOUBLE)"


#: Rows query, word, d for pairs (query, word) of pairs_: one step per unit of the query, over whole table rows.
DISTANCE = f"""pk AS (SELECT query, word, a, b FROM (SELECT query, word, {S.unit_keys_sql('query')} AS a, {S.unit_keys_sql('word')} AS b FROM pairs_) WHERE abs(len(a) - len(b)) <= 2),
dp(query, word, a, b, i, p2, p) AS (
    SELECT query, word, a, b, 0, []::DOUBLE[], list_transform(range(0, len(b) + 1), lambda j: j::DOUBLE) FROM pk
    UNION ALL
    SELECT query, word, a, b, i + 1, p, list_reduce(list_transform(range(1, len(b) + 1), lambda j: [j::DOUBLE]), lambda r, x: list_append(r, least(p[x[1]::INT + 1] + 1, r[-1] + 1, p[x[1]::INT] + {_replace_cost('a[i + 1]', 'b[x[1]::INT]')},
        CASE WHEN i > 0 AND x[1] > 1 AND a[i + 1] = b[x[1]::INT - 1] AND a[i] = b[x[1]::INT] AND a[i + 1] <> b[x[1]::INT] THEN p2[x[1]::INT - 1] + 0.8::DOUBLE ELSE 99::DOUBLE END)), [(i + 1)::DOUBLE])
    FROM dp WHERE i < len(a) AND list_min(p) <= 2.0),
ds AS (SELECT query, word, p[-1] AS d FROM dp WHERE i = len(a) AND p[-1] <= 2.0)"""


def _messages(errors: str, message: bool) -> str:
    tail = " || ':' || CASE e.code " + " ".join(f"WHEN {q(c)} THEN {q(m)}" for c, m in S.STRUCTURE_MESSAGE.items()) + " END" if message else ""
    return f"coalesce(array_to_string(list_transform({errors}, lambda e: e.index || ':' || e.code{tail}), '|'), '')"


_BAD = f"""bad AS (SELECT word, status FROM ws WHERE status IN ('structure', 'unknown')), x AS ({_deletes('bad')}), y AS ({_deletes('lex')}), pairs_ AS (SELECT DISTINCT x.word AS query, y.word AS word FROM x JOIN y USING (dk)), {DISTANCE},
rk AS (SELECT * FROM (SELECT query, word, round(d, 3) AS cost, row_number() OVER (PARTITION BY query ORDER BY d, freq DESC, word) AS rank FROM ds JOIN lex USING (word)) WHERE rank <= 15)"""
#: Rows conv_id, turn, pos, word, start, end, status, errors, s (list of cand and cost).
ISSUES = f"""{LEX}, {TALKW}, {BI3}, {STATUS}, {_BAD}, {CONTEXT},
occ AS (SELECT n.*, status FROM n JOIN bad USING (word)),
cd AS (SELECT conv_id, turn, pos, rk.word AS cand, rk.rank, cost, cost - (CASE WHEN l.w1 IS NULL THEN 0 ELSE 0.45::DOUBLE END + CASE WHEN r.w1 IS NULL THEN 0 ELSE 0.45::DOUBLE END) AS score
    FROM occ JOIN rk ON rk.query = occ.word LEFT JOIN b3 AS l ON l.w1 = prev AND l.w2 = rk.word LEFT JOIN b3 AS r ON r.w1 = rk.word AND r.w2 = next),
sg AS (SELECT conv_id, turn, pos, list(struct_pack(cand := cand, cost := cost) ORDER BY score, rank)[1:5] AS s FROM cd GROUP BY conv_id, turn, pos),
iss AS (SELECT conv_id, turn, pos, word, start, "end", status, CASE status WHEN 'structure' THEN {_messages(S.structure_errors_sql('word'), True)} ELSE '' END AS errors, coalesce(s, []) AS s FROM occ LEFT JOIN sg USING (conv_id, turn, pos)
    UNION ALL SELECT conv_id, turn, pos, word, start, "end", 'context', '', [struct_pack(cand := alt, cost := 0.4::DOUBLE)] FROM bst WHERE r = 1)"""
MATCHES = f"""m AS (SELECT conv_id || ':' || turn AS doc_id, t FROM k), {_TOK.replace("tk AS", "gt AS").replace("FROM tk ", "FROM gt ")}, {_SENT},
gi AS (SELECT doc_id, rule, {_SEV} AS severity, {_MSG} AS message, start, "end", replacement, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end", ord, rule) AS no FROM ({_ISSUES})),
both_ AS (SELECT conv_id || ':' || turn AS doc_id, 0 AS o, pos AS p, start AS off, to_json(struct_pack(message := CASE status WHEN 'structure' THEN 'Thaana structure error' ELSE 'Unknown word' END, shortMessage := 'Spelling', "offset" := start, length := "end" - start,
        replacements := list_transform(s, lambda v: struct_pack(value := v.cand)), rule := struct_pack(id := 'DV_SPELL_' || upper(status), description := 'Dhivehi spelling', issueType := 'misspelling', category := struct_pack(id := 'TYPOS', name := 'Spelling'))))::VARCHAR AS match FROM iss
    UNION ALL SELECT doc_id, 1, no, start, to_json(struct_pack(message := message, shortMessage := rule, "offset" := start, length := "end" - start, replacements := CASE WHEN replacement IS NULL THEN [] ELSE [struct_pack(value := replacement)] END,
        rule := struct_pack(id := 'DV_' || upper(replace(rule, '-', '_')), description := message, issueType := CASE severity WHEN 'style' THEN 'style' ELSE 'grammar' END, category := struct_pack(id := 'GRAMMAR', name := 'Grammar'))))::VARCHAR FROM gi)"""

_H = lambda *c: "md5(concat_ws(':', '42', " + ", ".join(c) + "))"
TRIALS = f"""{CORRUPT},
fq AS (SELECT word, freq, ('0x' || substring(md5(word), 1, 4))::BIGINT % 256 AS b FROM lex WHERE word IN (SELECT word FROM pool)),
ends AS (SELECT word, freq, sum(freq) OVER (ORDER BY b, word) AS e FROM fq),
dr AS (SELECT draw, word FROM (SELECT k AS draw, ('0x' || substring(md5('42:' || k), 1, 12))::BIGINT % (SELECT sum(freq) FROM fq) AS a FROM range(0, 750) AS r(k)) JOIN ends ON a < e AND a >= e - freq),
tr AS (SELECT draw::INT AS draw, word, kind, wrong FROM (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY {_H('draw::VARCHAR', 'kind')}, kind, {_H('draw::VARCHAR', 'kind', 'wrong')}, wrong) AS r FROM dr JOIN cr USING (word) WHERE wrong <> word AND wrong NOT IN (SELECT word FROM lex)) WHERE r = 1 ORDER BY draw LIMIT 500)"""
_SAMPLE = f"""SELECT word, freq FROM lex WHERE len({S.chunks_sql('word')}) >= 3 ORDER BY -ln((('0x' || substring(md5('42:' || word), 1, 12))::BIGINT::DOUBLE + 1) / {float(16**12 + 1)!r}) / freq, word LIMIT 500"""
SUMMARY = f"""ku AS (SELECT wrong AS word FROM tr UNION SELECT word FROM ({_SAMPLE})), {STATUS}, {_BAD},
jd AS (SELECT tr.kind, (ws.status IN ('structure', 'unknown'))::BIGINT AS d, coalesce(rk.rank, 99) AS rank FROM tr JOIN ws ON ws.word = wrong LEFT JOIN rk ON rk.query = wrong AND rk.word = tr.word)"""


def _page(html: str) -> str:
    """Text outside tags, comments, scripts and styles, joined by spaces; the references that the pages use are decoded."""
    for tag in ("script", "style", "noscript"):
        html = f"regexp_replace({html}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', '<i>', 'g')"
    text = f"array_to_string(list_filter(regexp_split_to_array({html}, '(?s)<!--.*?-->|<[!?/]?[A-Za-z!?][^<>]*>'), lambda x: x <> ''), ' ')"
    for name, ch in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("nbsp", " "), ("#39", "'"), ("amp", "&")):
        text = f"replace({text}, '&{name};', {q(ch)})"
    return text


def _clean(text: str) -> str:
    for pattern, new in CLEAN_MARKUP:
        text = f"regexp_replace({text}, {q(pattern)}, {q(new)}, 'g')"
    return text


_HASH = "md5(concat_ws(':', '0', doc_id::VARCHAR, k::VARCHAR))"
PARA_ROWS = f"""{THES}, {ALT(0)}, rn AS (SELECT doc_id, unnest(r) AS run, generate_subscripts(r, 1) - 1 AS k FROM (SELECT doc_id, regexp_extract_all(t, '[{TZ}]+|[^{TZ}]+') AS r FROM d)),
c0 AS (SELECT rn.*, translate(run, '{S.ZERO_WIDTH}', '') AS word, choices, choices IS NOT NULL AND ('0x' || substring({_HASH}, 1, 7))::BIGINT % 1000000 < 500000 AS swap, ('0x' || substring({_HASH}, 9, 7))::BIGINT AS pick FROM rn LEFT JOIN al ON al.word = translate(run, '{S.ZERO_WIDTH}', '')),
ch AS (SELECT *, CASE WHEN swap THEN choices[pick % len(choices) + 1] ELSE coalesce(nullif(word, ''), run) END AS run_out FROM c0)"""
PARA = f"""{PARA_ROWS}, px AS (SELECT doc_id, string_agg(run_out, '' ORDER BY k) AS text, sum(swap::INT)::BIGINT AS swapped, count(choices) AS swappable FROM ch GROUP BY doc_id)
SELECT doc_id, coalesce(text, '') AS text, coalesce(swapped, 0) AS swapped, coalesce(swappable, 0) AS swappable FROM d LEFT JOIN px USING (doc_id)"""

ORACLES: dict[str, str] = {
    "latin_to_thaana": f"SELECT doc_id, {_by_chunks("coalesce(text, '')")} AS t FROM documents",
    "thaana_to_latin": f"WITH {D} SELECT doc_id, {S.thaana_to_latin_sql('t')} AS l FROM d",
    "tokens_offsets": f"WITH {D} {_tokens('d', 'doc_id')}",
    "unit_parse": f"WITH {WORDS} SELECT word, array_to_string({S.unit_keys_sql('word')}, ' ') AS units, len({S.unit_keys_sql('word')}) AS n FROM u",
    "structure_errors": f"WITH {WORDS}, x AS (SELECT DISTINCT substring(word, 2) || left(word, 1) AS word FROM u WHERE length(word) >= 2) SELECT word, coalesce(array_to_string(list_transform({S.structure_errors_sql('word')}, lambda e: e.index || ':' || e.code), ' '), '') AS errors FROM x",
    "unigrams": f"WITH {WORDS} SELECT word, cnt FROM u",
    "bigrams": f"WITH {WORDS}, {BI} SELECT w1, w2, cnt FROM bi",
    "char_frequency": f"WITH {LEX} SELECT ch, count(*) AS cnt FROM (SELECT unnest(string_split(word, '')) AS ch FROM lex) GROUP BY ch",
    "derived_lexicon": f"WITH {LEX} SELECT word, freq FROM lex",
    "new_words": f"WITH {LEX}, {TALKW} SELECT word, least(cnt, 100000)::BIGINT AS freq FROM ku WHERE cnt >= 3 AND length(word) >= 2 AND {S.is_well_formed_sql('word')} AND word NOT IN (SELECT word FROM lex)",
    "merge_counts": f"WITH {WORDS}, {TALKW} SELECT word, sum(cnt)::BIGINT AS cnt FROM (SELECT word, cnt FROM u UNION ALL SELECT word, cnt FROM ku) GROUP BY word",
    "lexicon_upsert": f"WITH {LEX}, {TALKW} SELECT word, max(freq)::BIGINT AS freq FROM (SELECT word, freq FROM lex UNION ALL SELECT word, cnt FROM ku) GROUP BY word",
    "headword_harvest": f"WITH {DEFS}, h AS (SELECT {S.words_sql('head')} AS w FROM df), p AS (SELECT len(w) AS n, unnest(w) AS word FROM h) SELECT word, max(CASE WHEN NOT {S.is_well_formed_sql('word')} THEN 20 WHEN n = 1 THEN 50 ELSE 30 END)::BIGINT AS freq FROM p WHERE length(word) >= 2 GROUP BY word",
    "morph_generate": f"WITH {LEX}, {RULE} {_generate("'nominal', 'verb', 'eve'")}",
    "morph_analyze": f"""WITH {LEX}, {RULE}, fm AS (SELECT DISTINCT form AS word FROM ({_generate("'nominal', 'verb'")})), {_analyze('fm')} SELECT word, stem, rank FROM ranked""",
    "word_status": f"WITH {LEX}, {TALKW}, {STATUS} SELECT word, status, via FROM ws",
    "delete_index": f"WITH {LEX} {_deletes('lex')}",
    "candidates": f"WITH {LEX}, {TALKW}, a AS (SELECT word FROM ku WHERE word NOT IN (SELECT word FROM lex)), x AS ({_deletes('a')}), y AS ({_deletes('lex')}) SELECT DISTINCT x.word AS query, y.word AS word FROM x JOIN y USING (dk)",
    "suggestions": f"""WITH RECURSIVE {LEX}, {TALKW}, a AS (SELECT word FROM ku WHERE word NOT IN (SELECT word FROM lex)), x AS ({_deletes('a')}), y AS ({_deletes('lex')}), pairs_ AS (SELECT DISTINCT x.word AS query, y.word AS word FROM x JOIN y USING (dk)), {DISTANCE}
        SELECT query, rank::INT AS rank, word, cost FROM (SELECT query, word, round(d, 3) AS cost, row_number() OVER (PARTITION BY query ORDER BY d, freq DESC, word) AS rank FROM ds JOIN lex USING (word)) WHERE rank <= 5""",
    "context_errors": f'WITH {LEX}, {TALK}, {BI3}, {CONTEXT} SELECT conv_id, turn, pos, word, start, "end", alt FROM bst WHERE r = 1',
    **{f"grammar_{name}": f"WITH {head} {body}" for name, (head, body) in GRAMMAR.items()},
    "grammar_issues": f'WITH {M}, {_TOK}, {_SENT} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end", ord, rule)::INT AS no, rule, {_SEV} AS severity, {_MSG} AS message, start, "end", replacement FROM ({_ISSUES})',
    "grammar_fixed": f"""WITH {M}, {_TOK}, {_SENT}, fx AS (SELECT doc_id, list(struct_pack(st := start, en := "end", put := replacement) ORDER BY start, "end" DESC) AS f FROM ({_ISSUES}) WHERE replacement IS NOT NULL GROUP BY doc_id),
        done AS (SELECT doc_id, t, list_reduce(f, lambda r, x: CASE WHEN x.st >= r.en THEN struct_pack(st := 0, en := x.en, put := r.put || substring(t, r.en + 1, x.st - r.en) || x.put) ELSE r END, struct_pack(st := 0, en := 0, put := '')) AS r FROM m LEFT JOIN fx USING (doc_id))
        SELECT doc_id, CASE WHEN r IS NULL THEN t ELSE r.put || substring(t, r.en + 1) END AS t FROM done""",
    "to_formal": f"WITH {D} {_convert('d', _formal)}",
    "to_informal": f"WITH {D}, fo AS ({_convert('d', _formal)}) {_convert('fo', _informal)}",
    "define_exact": f"WITH {DEFS} SELECT head, sense_no, sense FROM df WHERE head = (SELECT min(head) FROM df)",
    "define_prefix": f"WITH {DEFS} SELECT head, arg_min(sense, sense_no) AS sense FROM df WHERE starts_with(head, 'ބ') AND head <> 'ބ' GROUP BY head ORDER BY head LIMIT 30",
    "inverted_index": f"WITH {DEFS}, {INDEX} SELECT term, head FROM ix",
    "reverse_lookup": f"""WITH {DEFS}, {INDEX}, a AS (SELECT min(sense) AS s FROM df), tm AS (SELECT DISTINCT term FROM (SELECT unnest({S.words_sql('s')}) AS term FROM a) WHERE length(term) >= 2),
        hd AS (SELECT head FROM ix JOIN tm USING (term) GROUP BY head HAVING count(*) = (SELECT count(*) FROM tm)), fs AS (SELECT head, arg_min(sense, sense_no) AS sense FROM df GROUP BY head)
        SELECT head, sense FROM hd JOIN fs USING (head) WHERE head <> (SELECT s FROM a) ORDER BY length(sense), head LIMIT 50""",
    "dictionary_stats": f"WITH {LEX}, {DEFS}, {BI3}, {SYN} SELECT 'lexicon' AS name, count(*) AS n FROM lex UNION ALL SELECT 'definitions', count(*) FROM df UNION ALL SELECT 'thesaurus', count(*) FROM sy",
    "thesaurus": f"WITH {THES} SELECT word, ord, syn, cnt FROM th",
    "alternatives": f"WITH {THES}, {ALT(3)} SELECT word, array_to_string(choices, '|') AS choices FROM al",
    "paraphrase_hash": f"WITH {PARA}",
    "clean_markup": f"SELECT page_id, {_clean("coalesce(html, '')")} AS text FROM pages",
    "unknown_top": f"WITH {LEX}, {TALKW}, {STATUS} SELECT word, cnt FROM ku JOIN ws USING (word) WHERE status = 'unknown' ORDER BY cnt DESC, word LIMIT 100",
    "eval_corruptions": f"WITH {LEX}, {CORRUPT} SELECT word, kind, wrong FROM cr WHERE wrong <> word",
    "page_text": f"SELECT page_id, {_page('html')} AS text FROM pages",
    "spell_issues": f"""WITH RECURSIVE {ISSUES} SELECT conv_id, turn, pos, word, start, "end", status, errors, coalesce(array_to_string(list_transform(s, lambda v: v.cand || ':' || v.cost), '|'), '') AS suggestions FROM iss""",
    "editor_matches": f"""WITH RECURSIVE {ISSUES}, {MATCHES} SELECT split_part(doc_id, ':', 1)::BIGINT AS conv_id, split_part(doc_id, ':', 2)::INT AS turn, (row_number() OVER (PARTITION BY doc_id ORDER BY off, o, p))::INT AS no, off AS "offset", match FROM both_""",
    "check_words": f"""WITH RECURSIVE {LEX}, {TALKW}, {STATUS}, {_BAD}, sg AS (SELECT query, string_agg(word, '|' ORDER BY rank) AS s FROM rk WHERE rank <= 5 GROUP BY query)
        SELECT word, status, via, CASE status WHEN 'structure' THEN {_messages(S.structure_errors_sql('word'), False)} ELSE '' END AS errors, coalesce(s, '') AS suggestions FROM ws LEFT JOIN sg ON query = word""",
    "frequency": f"WITH {LEX}, {TALKW} SELECT word, coalesce(freq, 0) AS freq FROM ku LEFT JOIN lex USING (word)",
    "suggestions_one_edit": f"""WITH RECURSIVE {LEX}, {TALKW}, a AS (SELECT word FROM ku WHERE word NOT IN (SELECT word FROM lex)), x AS ({_deletes1('a')}), y AS ({_deletes1('lex')}), pairs_ AS (SELECT DISTINCT x.word AS query, y.word AS word FROM x JOIN y USING (dk)), {DISTANCE}
        SELECT query, rank::INT AS rank, word, cost FROM (SELECT query, word, round(d, 2) AS cost, row_number() OVER (PARTITION BY query ORDER BY d, freq DESC, word) AS rank FROM ds JOIN lex USING (word)) WHERE rank <= 5""",
    "paraphrase_replacements": f"""WITH {PARA_ROWS}, en AS (SELECT *, sum(length(run_out)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM ch) SELECT doc_id, (e - length(run_out))::INT AS start, e::INT AS "end", word AS original, len(choices)::INT AS choices, CASE WHEN swap THEN run_out END AS used FROM en WHERE choices IS NOT NULL""",
    "eval_trials": f"WITH {LEX}, {TRIALS} SELECT draw, word, kind, wrong FROM tr",
    "eval_summary": f"""WITH RECURSIVE {LEX}, {TRIALS}, {SUMMARY} SELECT coalesce(kind, 'TOTAL') AS kind, count(*) AS n, sum(d)::BIGINT AS detected, sum(d * (rank <= 1)::INT)::BIGINT AS top1, sum(d * (rank <= 5)::INT)::BIGINT AS top5 FROM jd GROUP BY ROLLUP (kind)
        UNION ALL SELECT 'FALSE_POSITIVES', count(*), coalesce(sum((status IN ('structure', 'unknown'))::INT), 0)::BIGINT, 0, 0 FROM ({_SAMPLE}) JOIN ws USING (word)""",
    "eval_sample": f"WITH {LEX} SELECT word, freq FROM lex WHERE len({S.chunks_sql('word')}) >= 3 ORDER BY -ln((('0x' || substring(md5('42:' || word), 1, 12))::BIGINT::DOUBLE + 1) / {float(16**12 + 1)!r}) / freq, word LIMIT 500",
    "hunspell_rep": f"SELECT no::INT AS no, a, b FROM (VALUES {_values([(k, a, b) for k, (a, b) in enumerate(replacement_pairs())])}) AS t(no, a, b)",
    "hunspell_try": f"WITH {LEX} SELECT string_agg(ch, '' ORDER BY cnt DESC, ch) AS try FROM (SELECT ch, count(*) AS cnt FROM (SELECT unnest(string_split(word, '')) AS ch FROM lex) GROUP BY ch)",
    "hunspell_sfx": f"WITH {RULE} SELECT (row_number() OVER (ORDER BY CASE kind WHEN 'nominal' THEN 0 WHEN 'verb' THEN 1 ELSE 2 END, rule_no) - 1)::INT AS no, 'SFX A ' || CASE remove WHEN '' THEN '0' ELSE remove END || ' ' || append || ' ' || CASE remove WHEN '' THEN '.' ELSE remove END AS line FROM rules",
    "lexicon_bundle": f"WITH {LEX} SELECT word, word || chr(9) || freq AS line FROM lex",
}
