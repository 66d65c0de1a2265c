import random

import pytest
from pyspark.sql import functions as F

from akuru.functions import script as S
from akuru.functions.udfs import distances, plain_html_text
from akuru.operators import corpus, grammar
from akuru.plans import catalogue
from tests.oracle import same
from tests.plain import unit_distance


def column(spark, values, make, name="x"):
    """make(column) for each value, in order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, {name} string")
    return [r.y for r in df.select("i", make(F.col(name)).alias("y")).orderBy("i").collect()]


def test_transliteration(spark):
    pairs = {"dhivehi": "ދިވެހި", "maale": "މާލެ", "dhoani": "ދޯނި", "loabi": "ލޯބި", "fas": "ފަސް", "rah": "ރަށް", "varah reethi": "ވަރަށް ރީތި", "kan'du": "ކަނޑު", "ufaa": "އުފާ", "123 !": "123 !", "": "", "oaa c Ch x": "އޯއަ c ޗް ކްސް"}
    assert column(spark, pairs, S.latin_to_thaana) == list(pairs.values())
    assert column(spark, ["ދިވެހި", "މާލެ"], S.thaana_to_latin) == ["dhivehi", "maale"]
    assert column(spark, [None], S.latin_to_thaana) == [None]


def test_tokens_slice_back(spark):
    text = "hello ދިވެހި 123 \U0001f600ރާއް‌ޖެ! ‌"
    rows = corpus.tokens(spark.createDataFrame([(1, text)], "k int, t string"), "k").orderBy("pos").collect()
    assert [r.word for r in rows] == ["ދިވެހި", "ރާއްޖެ"]
    assert [text[r.start : r.end].replace("‌", "") for r in rows] == [r.word for r in rows]


def test_structure(spark):
    codes = column(spark, ["ދިވެހި", "ކަނޑު", "ހަނދު", "ކުރުނބާ", "ދިވެހ", "ކަނތު", "ަދިވެހި", "aދި", ""], lambda w: F.transform(S.structure_errors(w), lambda e: F.concat_ws(":", e.index.cast("string"), e.code)))
    assert codes == [[], [], [], [], ["4:missing-fili"], ["2:missing-fili"], ["0:orphan-fili"], ["0:non-thaana"], []]


def test_units_and_deletes(spark):
    assert [tuple(u) for u in column(spark, ["ކަނޑު"], S.units)[0]] == [("ކ", "ަ"), ("ނ", None), ("ޑ", "ު")]
    got = column(spark, ["ދިވެހި", "މަގު"], lambda w: S.deletes(S.unit_keys(w), S.edits_allowed(S.unit_keys(w))))
    assert set(got[0]) == {"ދިވެހި", "ވެހި", "ދިހި", "ދިވެ", "ހި", "ވެ", "ދި"} and set(got[1]) == {"މަގު", "ގު", "މަ"}


@pytest.mark.parametrize(
    "a, b, cost",
    [("ރާއްޖަ", "ރާއްޖެ", 0.7), ("ރާއްޖަ", "ކުއްޖާ", 1.9), ("ސުކުރިއްޔާ", "ޝުކުރިއްޔާ", 1.0), ("ދިވެހ_", "ދިވެހި", 0.7), ("ކަންޑު", "ކަނ_ޑު", 0.4), ("ކަނ_ޑު", "ކަންޑު", 0.7), ("އަބަ", "ބައަ", 0.8), ("އަ", "އަބަތަމަ", 3.0)],
)
def test_distance(a, b, cost):
    keys = lambda s: [s[k : k + 2] for k in range(0, len(s), 2)]
    assert distances([a], [b])[0] == pytest.approx(cost) == unit_distance(keys(a), keys(b))


def test_distances_of_many_pairs():
    rng = random.Random(5)
    unit = lambda: rng.choice("ހނރސޞކޤއ-") + rng.choice("ަާިީް_")
    pairs = []
    for _ in range(5000):
        a = [unit() for _ in range(rng.randrange(8))]
        b = list(a)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(b) + 1)
            b = rng.choice([b[:k] + [unit()] + b[k:], b[:k] + b[k + 1 :], b[:k] + b[k + 1 : k + 2] + b[k : k + 1] + b[k + 2 :], b[:k] + [unit()] + b[k + 1 :]])
        pairs.append((a, b))
    got = distances(["".join(a) for a, _ in pairs], ["".join(b) for _, b in pairs])
    assert got.tolist() == [unit_distance(a, b) for a, b in pairs]


def test_an_early_end_is_kept():
    """A swap reaches over a row whose least value is above the limit; the search has ended by then."""
    a, b = ["އަ", "ބަ", "ތަ", "މަ"], ["އާ", "ބަ", "މަ", "ތަ"]
    assert unit_distance(a, b, 1.0) == 2.0 == distances(["".join(a)], ["".join(b)], 1.0)[0]


def test_html_text():
    assert plain_html_text("<p>a &amp; b<script>x</script><b>c</b>") == "a & b c"
    assert plain_html_text("<!-- <p> -->a<style>p > q</style><br/>b &am") == "a"
    assert plain_html_text("no tags &amp;") == "no tags &amp;" and plain_html_text(None) is None


def test_page_text_equals_its_sql_on_cut_references(spark, tmp_path):
    pages = ["<title>a&amp;&amp</title><p>b&am</p><p>c &quot;d&quot; &copy; e</p>", "<p>x &amp;lt; &middot;</p> &#39;y&#39; &lt;z&gt;", "<p>&amp&lt;</p>&copy<b>&unknown;</b>"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages")
    next((tmp_path / "pages").glob("part-*")).rename(tmp_path / "pages.parquet")
    same(spark, str(tmp_path), catalogue.QUERIES["page_text"], catalogue.ORACLES["page_text"])


def test_grammar_goldens(spark):
    def rules(text):
        df = spark.createDataFrame([(1, text)], "k int, t string")
        return [(r.rule, text[r.start : r.end], r.replacement) for r in grammar.check(df, "k").orderBy("no").collect()]

    assert rules("އަހަރެން މާލެ ދިޔައީމެވެ.") == []
    assert ("thaana-comma", " ,", "،") in rules("ރީތި , އުފާވެރި")
    assert not any(r[0] == "thaana-comma" for r in rules("hello, world"))
    assert any(r[0] == "space-before-punct" for r in rules("ދިޔައީމެވެ ،"))
    assert ("space-after-punct", ".", ". ") in rules("ދިޔައީމެވެ.އަދި")
    assert ("double-space", "  ", " ") in rules("އެއް  ދެ")
    assert rules("ވަރަށް ވަރަށް ރީތި") == [("repeated-word", "ވަރަށް ވަރަށް", "ވަރަށް")]
    assert rules("ދިޔައީ ދޯނީގައި އެވެ.") == [("detached-eve", "ދޯނީގައި އެވެ", "ދޯނީގައެވެ")]
    formal = "އަހަރެން މާލެ ދިޔައީމެވެ. " * 3
    assert rules(formal + "އެކަމަކު ކަނޑު ވަރަށް ގަދަ.") == [("formal-register", "ގަދަ", None)]
    assert not any(r[0] == "formal-register" for r in rules("އެކަމަކު ކަނޑު ވަރަށް ގަދަ. " * 3))


def test_fixes_reach_a_fixed_point(spark):
    text = "ރީތި , އުފާވެރި  ދިޔައީމެވެ.އަދި ވަރަށް ވަރަށް ރީތި"
    df = spark.createDataFrame([(1, text)], "k int, t string")
    fixed = df.select("k", grammar.fixed(F.col("t")).alias("t"))
    fixed = fixed.select("k", grammar.fixed(F.col("t")).alias("t"))  # overlapping fixes need a second pass
    assert grammar.check(fixed, "k").filter("replacement is not null").count() == 0


def test_long_runs_of_other_scripts(spark):
    """100,000 Latin characters before and after a word, in one sentence."""
    word = "ރީތި"
    text = "x" * 100_000 + " " + word + " " + "y z" * 50_000 + "  " * 20_000 + "."
    df = spark.createDataFrame([(1, text)], "k int, t string")
    got = [(r.rule, r.start, r.end) for r in grammar.check(df, "k").collect()]
    assert got == [("double-space", len(text) - 40_001, len(text) - 1), ("space-before-punct", len(text) - 40_001, len(text))]
    many = " ".join([word] * 41)
    df = spark.createDataFrame([(1, "x" * 100_000 + many + "y" * 100_000)], "k int, t string")
    assert [(r.start, r.end) for r in grammar.check(df, "k").filter("rule = 'long-sentence'").collect()] == [(100_000, 100_000 + len(many))]
    assert column(spark, [text], lambda t: grammar.convert(t, grammar.to_formal_word)) == [text.replace(word, word + "އެވެ")]


def test_texts_with_equal_keys_stay_apart(spark):
    df = spark.createDataFrame([(1, "ރީތި ރީތި"), (1, "ރީތި ރީތި"), (1, "")], "k int, t string")
    assert [(r.start, r.end) for r in grammar.check(df, "k").collect()] == [(0, 9), (0, 9)]
    assert sorted((r.pos, r.start) for r in corpus.tokens(df, "k").collect()) == [(0, 0), (0, 0), (1, 5), (1, 5)]


def test_offsets_in_long_texts(spark):
    text = "🙂 ".join(["ބަސް"] * 1000)
    got = corpus.tokens(spark.createDataFrame([(1, text)], "k int, t string"), "k", neighbours=True).collect()
    assert [(r.pos, r.start, r.end) for r in got] == [(k, 6 * k, 6 * k + 4) for k in range(1000)]
    assert got[0].prev is None and got[999].next is None and got[5].prev == "ބަސް"


def test_working_symbols_are_copied(spark):
    assert column(spark, ["\uE000", "ba\uE041b", "h\uE080a", "\uE0F0n'da"], S.latin_to_thaana) == ["\uE000", "ބަ\uE041ބް", "ށ\uE080އަ".replace("ށ", "ށް"), "\uE0F0ނޑަ"]


def test_register(spark):
    formal = lambda t: grammar.convert(t, grammar.to_formal_word)
    informal = lambda t: grammar.convert(t, grammar.to_informal_word)
    texts = ["މޫސުން ވަރަށް ރީތި.", "ދިޔައީ މާލެއަށް.", "މޫސުން ރީތި. ކަނޑު މަޑު."]
    want = ["މޫސުން ވަރަށް ރީތިއެވެ.", "ދިޔައީ މާލެއަށެވެ.", "މޫސުން ރީތިއެވެ. ކަނޑު މަޑުއެވެ."]
    assert column(spark, texts, formal) == want and column(spark, want, formal) == want
    assert column(spark, [want[0], "އަހަރެން ދިޔައީމެވެ.", want[2]], informal) == [texts[0], "އަހަރެން ދިޔައީ.", texts[2]]
    assert column(spark, ["ކުރި", "ކަމަށް", "ދޯނީގައި"], grammar.merge_eve) == ["ކުރިއެވެ", "ކަމަށެވެ", "ދޯނީގައެވެ"]


def test_fixing_works_out_only_rules_that_replace(spark):
    df = spark.createDataFrame([(1, "x")], "k int, t string")
    whole = df.select(grammar.fixed(F.col("t")))._jdf.queryExecution().analyzed().toString()
    some = df.select(grammar.fixed(F.col("t"), tuple(r for r in grammar.RULES if r not in ("long_sentences", "formal_register"))))._jdf.queryExecution().analyzed().toString()
    assert whole.count("regexp_extract_all") == some.count("regexp_extract_all")


def test_fixed_of_many_issues_and_long_gaps(spark):
    rng = random.Random(2)
    parts = [rng.choice(["މާލެ ,", "މާލެ މާލެ ", "x" * rng.choice((1, 1023, 1024, 3000)) + " ", "\U0001F600  ", "ދިޔަ އެވެ. ", "a b "]) for _ in range(400)]
    text = "".join(parts)
    rows = column(spark, [text, "", "abc"], lambda c: grammar.fixed(c))
    found = [r for r in spark.createDataFrame([(1, text)], "k int, t string").transform(lambda d: grammar.check(d, "k")).collect() if r.replacement is not None]
    out, at = "", 0
    for r in sorted(found, key=lambda r: (r.start, -r.end, r.replacement)):
        if r.start >= at:
            out, at = out + text[at : r.start] + r.replacement, r.end
    assert rows == [out + text[at:], "", "abc"] and len(found) > 200
