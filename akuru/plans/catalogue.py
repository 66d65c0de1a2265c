"""The registered queries of the language operators, each with its DuckDB restatement where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import script as S
from ..functions.udfs import html_text as html_text_udf
from ..operators import corpus, dictionary, evaluation, export, grammar, morphology, paraphrase, spelling
from ..sources.scratch import stored
from .restatements import ORACLES  # noqa: F401  part of this module's interface


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.thaana(_table(spark, sf, "documents"), "doc_id")


def _talk(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.thaana(_table(spark, sf, "conversations"), "conv_id", "turn")


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.unigrams(_docs(spark, sf))


def _lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """The lexicon that documents give; stored, as several branches of a query read it."""
    return stored(corpus.derived_lexicon(_counts(spark, sf)), "lexicon")


def _bigrams(spark: SparkSession, sf: str) -> DataFrame:
    return stored(corpus.bigrams(_docs(spark, sf)).filter("cnt >= 3"), "bigrams")


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with every kind of fault put in by rules on doc_id."""
    t = F.replace("t", F.lit(". "), F.lit(" .  "))
    t = F.when(F.col("doc_id") % 3 == 1, F.replace(t, F.lit(","), F.lit("?"))).when(F.col("doc_id") % 3 == 2, F.replace(t, F.lit(","), F.lit(" ;"))).otherwise(t)
    t = F.when(F.col("doc_id") % 4 == 1, F.replace(t, F.lit("ް ."), F.lit("ެވެ ."))).otherwise(t)
    return _docs(spark, sf).select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.replace(t, F.lit("ން "), F.lit(f"ން {grammar.EVE} "))).otherwise(t).alias("t"))


def _definitions(spark: SparkSession, sf: str) -> DataFrame:
    part = _table(spark, sf, "part")
    head, one, two = (S.latin_to_thaana(F.lower(c)) for c in ("p_name", "p_type", "p_brand"))
    senses = F.array(F.struct((F.col("p_partkey") * 2).alias("sense_no"), one.alias("sense")), F.struct((F.col("p_partkey") * 2 + 1).alias("sense_no"), two.alias("sense")))
    return part.select(head.alias("head"), F.explode(senses).alias("s")).select("head", "s.sense_no", "s.sense")


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return _bigrams(spark, sf).select(F.col("w1").alias("head"), F.concat("w2", F.lit(" (1) a")).alias("sense"))


def _thesaurus(spark: SparkSession, sf: str) -> DataFrame:
    # all counts wanted are those of words in the pairs, so at least theirs
    counted = stored(corpus.counted(_table(spark, sf, "documents")).filter("cnt >= 3"), "counted")
    entries = counted.filter("w2 <> ''").select(F.col("w1").alias("head"), F.concat("w2", F.lit(" (1) a")).alias("sense"))
    counts = counted.filter("w2 = ''").select(F.col("w1").alias("word"), "cnt")
    return stored(paraphrase.attested(corpus.harvest_synonyms(entries), counts), "thesaurus")


def _latin(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their text as it is, for operators that transliterate; dealt out as thaana() does."""
    df = _table(spark, sf, "documents").select("doc_id", F.col("text").alias("t"))
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def _corrupted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    lexicon = _lexicon(spark, sf)
    return lexicon, evaluation.corruptions(evaluation.pool(lexicon))


def latin_to_thaana(spark, sf):
    return _docs(spark, sf)


def thaana_to_latin(spark, sf):
    return _docs(spark, sf).select("doc_id", S.thaana_to_latin(F.col("t")).alias("l"))


def tokens_offsets(spark, sf):
    return corpus.tokens(_docs(spark, sf), "doc_id")


def unit_parse(spark, sf):
    return _counts(spark, sf).select("word", F.array_join(S.unit_keys(F.col("word")), " ").alias("units"), F.size(S.units(F.col("word"))).cast("long").alias("n"))


def structure_errors(spark, sf):
    wrong = _counts(spark, sf).filter("length(word) >= 2").select(F.expr("concat(substring(word, 2), left(word, 1))").alias("word")).distinct()
    errors = F.transform(S.structure_errors(F.col("word")), lambda e: F.concat_ws(":", e.index.cast("string"), e.code))
    return wrong.select("word", F.array_join(errors, " ").alias("errors"))


def unigrams(spark, sf):
    return _counts(spark, sf)


def bigrams(spark, sf):
    return corpus.bigrams(_docs(spark, sf))


def char_frequency(spark, sf):
    return corpus.char_frequency(_lexicon(spark, sf))


def derived_lexicon(spark, sf):
    return corpus.derived_lexicon(_counts(spark, sf))


def new_words(spark, sf):
    return corpus.new_words(corpus.derived_lexicon(corpus.unigrams(_talk(spark, sf))), _lexicon(spark, sf))


def merge_counts(spark, sf):
    return corpus.merge_counts(_counts(spark, sf), corpus.unigrams(_talk(spark, sf)))


def lexicon_upsert(spark, sf):
    return corpus.upsert(corpus.derived_lexicon(_counts(spark, sf)), corpus.unigrams(_talk(spark, sf)).select("word", F.col("cnt").alias("freq")))


def headword_harvest(spark, sf):
    return corpus.harvest_headwords(_definitions(spark, sf).select("head"))


def morph_generate(spark, sf):
    return morphology.generate(_lexicon(spark, sf).select(F.col("word").alias("stem")), "nominal", "verb", "eve")


def morph_analyze(spark, sf):
    lexicon = _lexicon(spark, sf)
    forms = morphology.generate(lexicon.select(F.col("word").alias("stem")), "nominal", "verb").select(F.col("form").alias("word")).distinct()
    return morphology.analyze(forms, lexicon)


def word_status(spark, sf):
    return spelling.word_status(corpus.unigrams(_talk(spark, sf)), _lexicon(spark, sf))


def delete_index(spark, sf):
    return spelling.delete_index(_lexicon(spark, sf))


def candidates(spark, sf):
    lexicon = _lexicon(spark, sf)
    words = spelling.unlisted(corpus.unigrams(_talk(spark, sf)), lexicon)
    return spelling.candidates(words, lexicon)


def suggestions(spark, sf):
    lexicon = _lexicon(spark, sf)
    words = spelling.unlisted(corpus.unigrams(_talk(spark, sf)), lexicon)
    return spelling.rank(words, lexicon)


def context_errors(spark, sf):
    talk = corpus.tokens(_talk(spark, sf), "conv_id", "turn", neighbours=True)
    return spelling.context_errors(talk, _lexicon(spark, sf), _bigrams(spark, sf), "conv_id", "turn")


def spell_issues(spark, sf):
    talk = corpus.tokens(_talk(spark, sf), "conv_id", "turn", neighbours=True)
    issues = spelling.check_text(talk, _lexicon(spark, sf), _bigrams(spark, sf), "conv_id", "turn")
    errors = F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e.index.cast("string"), e.code, e.message)), "|")
    suggestions = F.array_join(F.transform("suggestions", lambda s: F.concat_ws(":", s.word, s.cost.cast("string"))), "|")
    return issues.withColumns({"errors": errors, "suggestions": suggestions})


def check_words(spark, sf):
    words = corpus.unigrams(_talk(spark, sf))
    out = spelling.check_words(words, _lexicon(spark, sf))
    errors = F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e.index.cast("string"), e.code)), "|")
    return out.withColumns({"errors": errors, "suggestions": F.array_join(F.transform("suggestions", lambda s: s.word), "|")})


def frequency(spark, sf):
    return spelling.frequency(corpus.unigrams(_talk(spark, sf)), _lexicon(spark, sf))


def suggestions_one_edit(spark, sf):
    """Suggestions from the smaller index of single deletes, costs to two places."""
    lexicon = _lexicon(spark, sf)
    words = spelling.unlisted(corpus.unigrams(_talk(spark, sf)), lexicon)
    return spelling.rank(words, lexicon, max_edits=1, places=2)


def _grammar(rule):
    return lambda spark, sf: grammar.issues(_marked(spark, sf), rule, "doc_id")


def grammar_issues(spark, sf):
    return grammar.check(_marked(spark, sf), "doc_id")


def grammar_fixed(spark, sf):
    return _marked(spark, sf).select("doc_id", grammar.fixed(F.col("t")).alias("t"))


def to_formal(spark, sf):
    return _docs(spark, sf).select("doc_id", grammar.convert(F.col("t"), grammar.to_formal_word).alias("t"))


def to_informal(spark, sf):
    return to_formal(spark, sf).select("doc_id", grammar.convert(F.col("t"), grammar.to_informal_word).alias("t"))


def define_exact(spark, sf):
    d = _definitions(spark, sf)
    return dictionary.define(d, d.agg(F.min("head")).first()[0] or "")


def define_prefix(spark, sf):
    return dictionary.browse(_definitions(spark, sf), "ބ")


def inverted_index(spark, sf):
    return dictionary.inverted_index(_definitions(spark, sf))


def reverse_lookup(spark, sf):
    d = _definitions(spark, sf)
    return dictionary.reverse_lookup(d, d.agg(F.min("sense")).first()[0] or "")


def dictionary_stats(spark, sf):
    return dictionary.stats(lexicon=_lexicon(spark, sf), definitions=_definitions(spark, sf), thesaurus=corpus.harvest_synonyms(_entries(spark, sf)))


def thesaurus(spark, sf):
    return _thesaurus(spark, sf)


def alternatives(spark, sf):
    out = paraphrase.alternatives(_thesaurus(spark, sf), modern_only=True)
    return out.select("word", F.array_join("choices", "|").alias("choices"))


def paraphrase_hash(spark, sf):
    return paraphrase.paraphrase(_latin(spark, sf), _thesaurus(spark, sf), "doc_id", latin=True, spans=False).drop("replacements")


def paraphrase_replacements(spark, sf):
    out = paraphrase.paraphrase(_latin(spark, sf), _thesaurus(spark, sf), "doc_id", latin=True)
    return out.select("doc_id", F.explode("replacements").alias("x")).select("doc_id", "x.*")


def paraphrase_exact(spark, sf):
    return paraphrase.paraphrase_exact(_latin(spark, sf), _thesaurus(spark, sf), "doc_id", latin=True, spans=False).select("doc_id", "text", "swapped", "swappable")


def clean_markup(spark, sf):
    return _table(spark, sf, "pages").select("page_id", corpus.clean_markup(F.coalesce("html", F.lit(""))).alias("text"))


def page_text(spark, sf):
    return _table(spark, sf, "pages").select("page_id", html_text_udf("html").alias("text"))


def unknown_top(spark, sf):
    words = stored(corpus.unigrams(_talk(spark, sf)), "words")
    return dictionary.unknown_top(words, spelling.word_status(words, _lexicon(spark, sf)))


def eval_corruptions(spark, sf):
    return _corrupted(spark, sf)[1]


def eval_sample(spark, sf):
    return evaluation.sample(evaluation.pool(_lexicon(spark, sf)), 500).select("word", "freq")


def eval_summary(spark, sf):
    lexicon = _lexicon(spark, sf)
    made = stored(evaluation.trials(lexicon), "trials")
    clean = stored(evaluation.sample(evaluation.pool(lexicon), 500).select("word"), "clean")
    wrong = made.select(F.col("wrong").alias("word")).distinct()
    status = spelling.word_status(wrong.union(clean).distinct(), lexicon)
    return evaluation.summary(made, status, spelling.rank(wrong, lexicon)).union(evaluation.false_positives(clean, status))


def eval_trials(spark, sf):
    return evaluation.trials(_lexicon(spark, sf))


def hunspell_rep(spark, sf):
    return export.rep_table(spark)


def hunspell_try(spark, sf):
    return export.try_characters(corpus.char_frequency(_lexicon(spark, sf)))


def hunspell_sfx(spark, sf):
    return export.suffix_lines(spark)


def lexicon_bundle(spark, sf):
    return export.bundle(_lexicon(spark, sf))


def editor_matches(spark, sf):
    talk = _talk(spark, sf)
    issues = spelling.check_text(corpus.tokens(talk, "conv_id", "turn", neighbours=True), _lexicon(spark, sf), _bigrams(spark, sf), "conv_id", "turn")
    return export.matches(issues, grammar.check(talk, "conv_id", "turn"), "conv_id", "turn")


_NAMED = (
    latin_to_thaana, thaana_to_latin, tokens_offsets, unit_parse, structure_errors, unigrams, bigrams, char_frequency, derived_lexicon, new_words, merge_counts, lexicon_upsert, headword_harvest,
    morph_generate, morph_analyze, word_status, delete_index, candidates, suggestions, context_errors, spell_issues, check_words, frequency, suggestions_one_edit, grammar_issues, grammar_fixed, to_formal, to_informal,
    define_exact, define_prefix, inverted_index, reverse_lookup, dictionary_stats, thesaurus, alternatives, paraphrase_hash, paraphrase_replacements, paraphrase_exact, clean_markup, page_text, unknown_top,
    eval_corruptions, eval_sample, eval_trials, eval_summary, hunspell_rep, hunspell_try, hunspell_sfx, lexicon_bundle, editor_matches,
)
QUERIES = {f.__name__: f for f in _NAMED} | {f"grammar_{name}": _grammar(rule) for name, rule in grammar.RULES.items()}
