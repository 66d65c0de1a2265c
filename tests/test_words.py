import hashlib
import random
import re
import uuid
from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from akuru.functions.batches import transliterated
from akuru.operators import corpus, dictionary, evaluation, export, morphology, paraphrase, spelling
from akuru.plans import catalogue
from akuru.sources import tables
from akuru.streaming import unknown

LEXICON = "ރާއްޖެ ކުއްޖާ ޝުކުރިއްޔާ ދިވެހި ދިހަ އަހަރެން ބަސް ވަރަށް ލޯބި ރަށް ފޮތް ދެއްކުން އެންމެ ބޮޑު ބޯޑު ކަނޑު މަސް ވެރިން".split()


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame([(w, 10) for w in LEXICON], "word string, freq long").cache()


def words(spark, *ws):
    return spark.createDataFrame([(w,) for w in ws], "word string")


def test_rule_counts():
    kinds = [r[0] for r in morphology.RULES]
    assert {k: kinds.count(k) for k in set(kinds)} == {"nominal": 96, "verb": 15, "eve": 3}


def test_generate(spark):
    stems = spark.createDataFrame([(s,) for s in "ރަށް ބަސް ނަން ވާހަކަ މަގު ދޯނި ގެ ކުރި ކުރުން".split()], "stem string")
    forms = {}
    for r in morphology.generate(stems, "nominal", "verb", "eve").collect():
        forms.setdefault(r.stem, set()).add(r.form)
    for stem, some in {
        "ރަށް": "ރަށުގައި ރަށުގެ ރަށުން ރަށަށް ރަށެއް ރަށަކީ ރަށްތައް ރަށްތަކުގައި ރަށާއި", "ބަސް": "ބަހުގެ ބަހަށް ބަހެއް ބަސްތައް", "ނަން": "ނަމުގެ ނަމެއް ނަމަކީ", "ވާހަކަ": "ވާހަކައިގެ",
        "މަގު": "މަގަށް", "ދޯނި": "ދޯނީގައި", "ގެ": "ގޭގައި", "ކުރި": "ކުރިއެވެ", "ކުރުން": "ކުރަނީ ކުރަން ކުރި ކުރީ ކުރާ ކުރާނެ ކުރޭ ކުރަމުން ކުރެވޭ ކުރެވުނު",
    }.items():
        assert set(some.split()) <= forms[stem]


def test_analysis_reverses_generation(spark):
    stems = "ރަށް ބަސް ނަން ވާހަކަ މަގު ދޯނި ގެ ފަޅޯ ކުރުން ބުނުން ލިޔުން".split()
    lex = words(spark, *stems)
    made = morphology.generate(lex.withColumnRenamed("word", "stem"), "nominal", "verb").collect()
    found = {(r.word, r.stem) for r in morphology.analyze(words(spark, *{r.form for r in made}, "ރަށުގައެވެ", "ބުނާނެއެވެ"), lex).collect()}
    assert {(r.form, r.stem) for r in made if r.form} <= found
    assert {("ރަށުގައެވެ", "ރަށް"), ("ބުނާނެއެވެ", "ބުނުން")} <= found


def test_word_status(spark, lexicon):
    asked = words(spark, "ރާއްޖެ", "ރާއްޖަ", "ރަށުގައި", "ފޮތެއް", "ދިވެހ", "ދެއްކަމުން", "ދިވެހިބަސްވެރިން", "އަހަރެންދިވެހި")
    got = {r.word: (r.status, r.via) for r in spelling.word_status(asked, lexicon).collect()}
    assert got["ރާއްޖެ"] == ("ok", None) and got["ރާއްޖަ"] == ("unknown", None) and got["ދިވެހ"] == ("structure", None)
    assert got["ރަށުގައި"] == ("ok-derived", "ރަށް") and got["ފޮތެއް"] == ("ok-derived", "ފޮތް") and got["ދެއްކަމުން"] == ("ok-derived", "ދެއްކުން")
    assert got["އަހަރެންދިވެހި"] == ("ok-derived", "އަހަރެން + ދިވެހި")


def test_suggestions_equal_brute_force(spark, lexicon):
    from tests.plain import unit_distance

    asked = ["ރާއްޖަ", "ސުކުރިއްޔާ", "ދިވެހ", "ބޮޑޫ", "ކަންޑު"]
    got = {}
    for r in spelling.rank(words(spark, *asked), lexicon).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.word, r.cost))
    assert got["ރާއްޖަ"][0] == ("ރާއްޖެ", 0.7) and got["ދިވެހ"] == [("ދިވެހި", 0.7), ("ދިހަ", 1.7)] and ("ޝުކުރިއްޔާ", 1.0) in got["ސުކުރިއްޔާ"]

    def keys(w):
        out = []
        for ch in w:
            if "ަ" <= ch <= "ް" and out and out[-1][1] == "_":
                out[-1] = out[-1][0] + ch
            else:
                out.append("-" + ch if "ަ" <= ch <= "ް" else ch + "_")
        return out

    def deleted(w):
        n = 1 if len(keys(w)) <= 2 else 2
        return {tuple(c) for k in range(n + 1) for c in combinations(keys(w), max(len(keys(w)) - k, 0))}

    for q in asked:
        every = sorted((d, w) for w in LEXICON if deleted(q) & deleted(w) and (d := unit_distance(keys(q), keys(w))) <= 2.0)[:5]
        assert got.get(q, []) == [(w, round(d, 3)) for d, w in every]


def test_texts_and_context(spark, lexicon):
    df = spark.createDataFrame([(1, "އަހަރެން ދިވެހ ބަސް"), (2, "އަހަރެން ވަރަށް ލޯބި"), (3, "އެންމެ ބޯޑު")], "k int, t string")
    pairs = spark.createDataFrame([("އެންމެ", "ބޮޑު", 9)], "w1 string, w2 string, cnt long")
    got = spelling.check_text(corpus.tokens(df, "k"), lexicon, pairs, "k").collect()
    assert sorted((r.k, r.word, r.status, r.suggestions[0].word) for r in got) == [(1, "ދިވެހ", "structure", "ދިވެހި"), (3, "ބޯޑު", "context", "ބޮޑު")]
    assert spelling.context_errors(corpus.tokens(df, "k"), lexicon, pairs, "k", evidence=10).count() == 0


def test_paraphrase(spark):
    thesaurus = spark.createDataFrame([("ހަހަރު", 1, "ލޯބި", 5), ("ހަހަރު", 2, "މަސް", 9), ("ލޯބި", 1, "ހަހަރު", 0)], "word string, ord int, syn string, cnt long")
    df = spark.createDataFrame([(1, "abc ހަހަރު ބަސް، ލޯބި!"), (2, "no words")], "k int, t string")
    still = {r.k: r for r in paraphrase.paraphrase_exact(df, thesaurus, "k", aggressiveness=0).collect()}
    assert still[1].text == "abc ހަހަރު ބަސް، ލޯބި!" and (still[1].swapped, still[1].swappable) == (0, 2)
    full = {r.k: r for r in paraphrase.paraphrase_exact(df, thesaurus, "k", aggressiveness=7, seed=3).collect()}
    rng = random.Random(3)
    rng.random()
    assert full[1].replacements[0].choices == 2 and full[1].replacements[0].used == rng.choice(["މަސް", "ލޯބި"])
    for r in full[1].replacements:
        assert full[1].text[r.start : r.end] == (r.used or r.original)
    assert still[2].text == "no words" and still[2].replacements == []
    empty = spark.createDataFrame([(1, ""), (1, ""), (2, None), (3, " \u200c!")], "k int, t string")
    for way in (paraphrase.paraphrase, paraphrase.paraphrase_exact):
        assert sorted((r.k, r.text, r.swappable) for r in way(empty, thesaurus, "k").collect()) == [(1, "", 0), (1, "", 0), (2, "", 0), (3, " \u200c!", 0)]
    hashed = paraphrase.paraphrase(df, thesaurus, "k", aggressiveness=1.0).filter("k = 1").first()
    assert all(hashed.text[r.start : r.end] == r.used for r in hashed.replacements) and hashed.swapped == 2
    modern = paraphrase.paraphrase(df, thesaurus, "k", aggressiveness=1.0, modern_only=True).filter("k = 1").first()
    assert (modern.swapped, modern.swappable) == (1, 1)


def test_dictionary(spark):
    d = spark.createDataFrame([("ބަސް", 1, "ދިވެހި ބަސް"), ("ބަސް", 2, "އެހެން"), ("ބަސްކޮޅު", 1, "ދިވެހި ބަސް ކޮޅު"), ("މަސް", 1, "ކަނޑު")], "head string, sense_no int, sense string")
    assert [r.sense for r in dictionary.define(d, "ބަސް").orderBy("sense_no").collect()] == ["ދިވެހި ބަސް", "އެހެން"]
    assert [r.head for r in dictionary.browse(d, "ބަސް").collect()] == ["ބަސްކޮޅު"] and dictionary.browse(d, "").count() == 0
    assert [r.head for r in dictionary.reverse_lookup(d, "ބަސް ދިވެހި").collect()] == ["ބަސް", "ބަސްކޮޅު"]
    assert dictionary.reverse_lookup(d, "ނެތް ބަސް").count() == 0


def test_files(spark, tmp_path, lexicon):
    (tmp_path / "a.tsv").write_text("﻿# words\nބަސް\t5\n\nބަސް\t7\nމަސް\tx\nކަނޑު\n", encoding="utf-8")
    assert {(r.word, r.freq) for r in tables.word_list(spark, str(tmp_path / "a.tsv")).collect()} == {("ބަސް", 7), ("މަސް", 1), ("ކަނޑު", 1)}
    (tmp_path / "b.tsv").write_text("a\tb\t3\na\tb\t4\n#x\tb\t1\n", encoding="utf-8")
    assert tables.counts(spark, str(tmp_path / "b.tsv"), pairs=True).first().cnt == 7 and tables.counts(spark, str(tmp_path / "b.tsv"), pairs=True, last_wins=True).first().cnt == 4
    (tmp_path / "t.tsv").write_text("w\ta:1:3|b|c:x\nw2\tz:2\nbad\nw2\ty:1\n", encoding="utf-8")
    assert sorted(map(tuple, tables.thesaurus(spark, str(tmp_path / "t.tsv")).collect())) == [("w", 1, "a:1", 3), ("w", 2, "b", 0), ("w", 3, "c", 0), ("w2", 1, "y", 1)]
    (tmp_path / "d.tsv").write_text("h\tone\ttwo\nh\tthree\n", encoding="utf-8")
    assert sorted(map(tuple, tables.definitions(spark, str(tmp_path / "d.tsv")).collect())) == [("h", 1, "one\ttwo"), ("h", 2, "three")]
    (tmp_path / "dump.js").write_text('var x = [["h ", "a  b"], ["", "z"], ["k", " "]];', encoding="utf-8")
    assert [tuple(r) for r in tables.array_dump(spark, str(tmp_path / "dump.js")).collect()] == [("h", "a b")]
    (tmp_path / "w.xml").write_text("<mediawiki><page><title>A</title><revision><text x='1'>{{a}} [[b|c]] d</text></revision></page></mediawiki>", encoding="utf-8")
    page = tables.wiki_pages(spark, str(tmp_path / "w.xml")).select(F.trim(corpus.clean_markup(F.col("text"))).alias("t")).first()
    assert page.t == "c d"
    export.write_dictionary(lexicon, str(tmp_path / "dic"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "dic")).collect()]
    assert lines[0] == str(len(LEXICON)) and lines[1:] == sorted(f"{w}/A" for w in LEXICON)
    tables.write_tsv(lexicon, str(tmp_path / "out"), "word")
    assert tables.word_list(spark, str(tmp_path / "out")).count() == len(LEXICON)
    aff = export.affix_lines(lexicon, corpus.char_frequency(lexicon))
    assert aff[0] == "SET UTF-8" and f"REP {len(export.replacement_pairs())}" in aff and sum(x.startswith("SFX A") for x in aff) == 115


def test_missing_files_folders_and_noted_files(spark, tmp_path, lexicon):
    (tmp_path / "a.tsv").write_text("ބަސް\t5\n", encoding="utf-8")
    (tmp_path / "b.tsv").write_text("ބަސް\t7\nމަސް\t2\n", encoding="utf-8")
    (tmp_path / "c.txt").write_text("ކަނޑު\t9\n", encoding="utf-8")
    there = str(tmp_path / "a.tsv")
    assert tables.word_list(spark, there, str(tmp_path / "none.tsv")).count() == 1
    assert tables.counts(spark, str(tmp_path / "none.tsv")).count() == 0 == tables.word_list(spark, str(tmp_path / "none.tsv")).count()
    assert sorted(map(tuple, tables.word_folder(spark, str(tmp_path)).collect())) == [("ބަސް", 7), ("މަސް", 2)]
    (tmp_path / "p.dat").write_text("x\ty\t3\n", encoding="utf-8")
    (tmp_path / "o.dat").write_text("x\ty\t4\n", encoding="utf-8")
    last = tables.counts(spark, str(tmp_path / "p.dat"), str(tmp_path / "o.dat"), pairs=True, last_wins=True)
    assert last.first().cnt == 4  # the last path given, not the last by name
    tables.write_lexicon(lexicon, str(tmp_path / "lex"), "made")
    lines = [x for f in sorted((tmp_path / "lex").glob("part-*")) for x in f.read_text(encoding="utf-8").splitlines()]
    assert lines == ["# made", *(f"{w}\t10" for w in sorted(LEXICON))]
    counted = spark.createDataFrame([("a", "b", 3), ("b", "c", 9), ("c", "d", 2)], "w1 string, w2 string, cnt long")
    tables.write_counts(counted, str(tmp_path / "pairs"), "pairs")
    lines = [x for f in sorted((tmp_path / "pairs").glob("part-*")) for x in f.read_text(encoding="utf-8").splitlines()]
    assert lines == ["# pairs", "b\tc\t9", "a\tb\t3"]


def test_evaluation(spark, lexicon):
    made = evaluation.corruptions(evaluation.pool(lexicon)).cache()
    kinds = {r.kind for r in made.select("kind").distinct().collect()}
    assert kinds == {"fili-swap", "confusion", "delete-unit", "transpose", "drop-sukun"}
    wrong = made.select(F.col("wrong").alias("word")).distinct()
    total = evaluation.summary(made, spelling.word_status(wrong, lexicon), spelling.rank(wrong, lexicon)).filter("kind = 'TOTAL'").first()
    assert total.n == made.count() and total.detected >= 0.92 * total.n and total.top1 >= 0.82 * total.n
    assert evaluation.passes(95, 87, 0) and not evaluation.passes(91, 87, 0)


def test_streaming_count(spark, lexicon, tmp_path):
    spark.createDataFrame([("ބަސް ނެތްބަހެކޭ",), ("ނެތްބަހެކޭ abc",)], "t string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    unknown.count_unknown(stream, lambda: lexicon, str(tmp_path / "total"), str(tmp_path / "check")).awaitTermination(120)
    assert [tuple(r) for r in unknown.totals(spark.read.parquet(str(tmp_path / "total"))).collect()] == [("ނެތްބަހެކޭ", 2)]


@pytest.mark.parametrize("name", ["spell_issues", "check_words", "editor_matches"])
def test_plan_reads_the_checked_texts_once(spark, sf, name):
    """What several branches read is stored: a plan with a branch's whole lineage in each filled the driver's memory."""
    plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("role#") <= 1  # a column of the input only; editor_matches reads the texts for grammar


def test_shuffled_pieces_hold_no_string_twice(spark):
    df = spark.createDataFrame([(1, "a މާލެ ‌ ބ‌ަސް b"), (2, "")], "k int, t string")
    got = [(r.k, r.gap, r.run, None if r.key.startswith("\x01") else r.key) for r in paraphrase._pieces(df, ("k",)).orderBy("k", "i").collect()]
    assert got == [(1, "a ", None, "މާލެ"), (1, " ", "‌", None), (1, " ", None, "ބަސް"), (1, " b", "", None), (2, "", "", None)]
    assert "word" not in paraphrase._pieces(df, ("k",)).columns


def test_delete_keys_are_not_broadcast(spark, lexicon):
    found = spelling.candidates(words(spark, "ރާއްޖޭ", "ބޮޑުު"), lexicon)
    assert "strategy=merge" in found._jdf.queryExecution().optimizedPlan().toString()  # however small the lexicon's files make the index look
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert ("ރާއްޖޭ", "ރާއްޖެ") in {tuple(r) for r in found.collect()}


def test_ranking_does_not_broadcast_delete_keys(spark, lexicon):
    plan = spelling.rank(words(spark, "ރާއްޖޭ"), lexicon)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan


def test_suggestions_never_broadcast_the_lexicon(spark, lexicon, tmp_path):
    lexicon.write.parquet(f"{tmp_path}/lexicon")
    lexicon = spark.read.parquet(f"{tmp_path}/lexicon")
    unknown = spelling.unlisted(words(spark, "ރާއްޖޭ", "ރާއްޖެ"), lexicon)
    found = spelling.rank(unknown, lexicon)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()  # by the size of its files it would be
    assert [(r.query, r.rank, r.word) for r in found.filter("rank = 1").collect()] == [("ރާއްޖޭ", 1, "ރާއްޖެ")]


def _shuffled(spark, run):
    """What run() returns, and the bytes that its jobs shuffled."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "")
    out = run()
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    spark.sparkContext._jsc.clearJobGroup()
    return out, sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages)


def _many(spark):
    """Long texts, whose words differ at the ends, their bytes, and a thesaurus with a few synonyms of most words, 70 of one."""
    letters = "ހށނރބކވމފދތލގސޑ"
    word = lambda i: "".join(letters[i // 15**k % 15] + "ަ" for k in range(3))
    rng = random.Random(5)
    texts = [(k, " ".join(word(min(rng.randrange(3000), rng.randrange(3000))) + rng.choice(["", "", "، ", "‌", "é"]) for _ in range(6000))) for k in range(40)]
    rows = [(word(i), j + 1, word(i * 7 + j), j % 5) for i in range(2500) for j in range(70 if i == 7 else i % 4)]
    return spark.createDataFrame(texts, "k int, t string").repartition(2).localCheckpoint(), texts, spark.createDataFrame(rows, "word string, ord int, syn string, cnt long"), rows


def _plainly(text, k, rows, exact):
    """The new text and its replacements, run by run."""
    syns = {}
    for w, _, s, _ in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        syns.setdefault(w, []).append(s)
    out, held, rng = "", [], random.Random(0)
    for no, run in enumerate(re.findall("[ހ-ޱ‌‍]+|[^ހ-ޱ‌‍]+", text)):
        word = re.sub("[‌‍]", "", run)
        known, used = syns.get(word), None
        if known:
            h = hashlib.md5(f"0:{k}:{no}".encode()).hexdigest()
            if exact:
                used = rng.choice(known) if rng.random() < 0.5 else None
            elif int(h[:7], 16) % 1_000_000 < 500_000:
                used = known[int(h[8:15], 16) % len(known)]
        new = used or word or run
        if known:
            held.append((len(out), len(out) + len(new), word, len(known), used))
        out += new
    return out, held


def _agrees(spark, way, exact, **more):
    df, texts, thesaurus, rows = _many(spark)
    got, moved = _shuffled(spark, way(df, thesaurus, "k", **more).collect)
    for r in got:
        text, held = _plainly(texts[r.k][1], r.k, rows, exact)
        assert (r.text, r.swapped, r.swappable) == (text, sum(h[4] is not None for h in held), len(held))
        assert r.replacements is None if more else [tuple(x) for x in r.replacements] == held
    assert len(got) == len(texts) and moved < sum(len(t.encode()) for _, t in texts)


def test_paraphrase_shuffles_texts_not_words(spark):
    _agrees(spark, paraphrase.paraphrase, False, spans=False)


def test_counted_pairs_equal_the_expressions(spark):
    texts = ["Hah rahah, ch'a n'a aai oaa xa-h ahé h", "a‌ b ‍  shaxi", "", None, " ", "hh aé²h", "ABC " * 50 + "ދިވެހި\nބަސް kuḥ h1 h\U0001F600"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    t = corpus.thaana(df, "k")
    want = {(r.w1, r.w2, r.cnt) for r in corpus.bigrams(t).collect()} | {(r.word, "", r.cnt) for r in corpus.unigrams(t).collect()}
    assert {(r.w1, r.w2, r.cnt) for r in corpus.counted(df).collect()} == want
    assert transliterated(pa.array([t or "" for t in texts])).to_pylist() == [r.t for r in t.orderBy("k").collect()]


def test_paraphrase_exact_shuffles_texts_not_words(spark):
    _agrees(spark, paraphrase.paraphrase_exact, True)


def test_replacements_shuffle_texts_not_words(spark):
    _agrees(spark, paraphrase.paraphrase, False)
