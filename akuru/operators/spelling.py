"""Spell checking as joins over distinct words: status, suggestions, errors in context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import script as S
from ..functions.udfs import distance
from ..sources.scratch import stored
from . import morphology

# Endings that are stripped, in this order.
SUFFIXES = ["ުގައި", "ގައި", "އަކަށް", "ަކަށް", "އަކީ", "ަކީ", "އެއް", "ެއް", "ތަކުގެ", "ތަކަށް", "ތައް", "އަށް", "ަށް", "އިން", "ުން", "ުގެ", "ގެ", "ާއި", "ަކު", "ން"]
MIN_EVIDENCE = 8
MAX_COST = 2.0
BONUS = 0.45


def _known(df: DataFrame, lexicon: DataFrame, column: str) -> DataFrame:
    return df.join(lexicon.select(F.col("word").alias(column)), column, "left_semi")


def suffix_stems(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, via): the first stem that stripping an ending finds in the lexicon."""
    table = words.sparkSession.createDataFrame([(k, s) for k, s in enumerate(SUFFIXES)], "ord int, suffix string")
    longest = max(map(len, SUFFIXES))
    cut = words.select("word", F.explode(F.expr(f"transform(sequence(1, least(length(word), {longest})), k -> right(word, k))")).alias("suffix"))
    cut = cut.join(F.broadcast(table), "suffix").withColumn("stem", F.expr("left(word, length(word) - length(suffix))")).filter("length(stem) >= 2")
    u = "ު"
    bare = F.try_element_at(F.transform(S.structure_errors(F.col("stem")), lambda e: e.code), F.lit(-1))
    tries = F.array(
        F.struct(F.lit(0).alias("t"), F.col("stem").alias("via")),
        F.struct(F.lit(1).alias("t"), F.when(F.col("stem").endswith(u), F.concat(F.expr("left(stem, length(stem) - 1)"), F.lit(S.SUKUN))).alias("via")),
        F.struct(F.lit(2).alias("t"), F.when(bare == "missing-fili", F.concat("stem", F.lit(S.SUKUN))).alias("via")),
    )
    tried = cut.select("word", "ord", F.explode(tries).alias("c")).select("word", "ord", "c.t", "c.via").filter("via is not null")
    return _known(tried, lexicon, "via").groupBy("word").agg(F.min(F.struct("ord", "t", "via")).alias("m")).select("word", F.col("m.via").alias("via"))


def compounds(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, via): the leftmost cut of a well-formed word of five units or more into two known words."""
    parts = S.chunks(F.col("word"))
    long = words.select("word", parts.alias("c")).filter((F.size("c") >= 5) & S.is_well_formed(F.col("word")))
    cuts = long.select("word", "c", F.explode(F.expr("sequence(2, size(c) - 2)")).alias("i"))
    cuts = cuts.select("word", "i", F.expr("array_join(slice(c, 1, i), '')").alias("l"), F.expr("array_join(slice(c, i + 1, size(c)), '')").alias("r"))
    found = _known(_known(cuts, lexicon, "l"), lexicon, "r").groupBy("word").agg(F.min(F.struct("i", "l", "r")).alias("m"))
    return found.select("word", F.concat("m.l", F.lit(" + "), "m.r").alias("via"))


def word_status(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, status, via) of distinct words; each later test only sees what the earlier ones left.

    The words are stored with what is wrong with them, so that the later tests don't work them out again, each in its own branch of the plan.
    """
    known = lexicon.select("word", F.lit(True).alias("hit"))
    met = words.select("word").distinct().join(known, "word", "left")
    first = stored(met.withColumn("bad", F.when(F.col("hit").isNull(), F.size(S.structure_errors(F.col("word"))) > 0)), "words")
    good = first.filter("not bad").select("word")
    morph = morphology.analyze(good, lexicon).filter("rank = 1").select("word", F.col("stem").alias("v1"))
    via = good.join(morph, "word", "left").join(suffix_stems(good, lexicon).withColumnRenamed("via", "v2"), "word", "left").join(compounds(good, lexicon).withColumnRenamed("via", "v3"), "word", "left")
    via = via.select("word", F.coalesce("v1", "v2", "v3").alias("via"))
    status = F.when(F.col("hit"), "ok").when(F.col("bad"), "structure").when(F.col("via").isNotNull(), "ok-derived").otherwise("unknown")
    return first.join(via, "word", "left").select("word", status.alias("status"), "via")


def _delete_keys(max_edits: int) -> Column:
    return S.let(S.unit_keys(F.col("word")), lambda k: S.deletes(k, F.least(S.edits_allowed(k), F.lit(max_edits))))


def delete_index(lexicon: DataFrame, max_edits: int = 2) -> DataFrame:
    """(dk, word): the delete keys of each well-formed word."""
    fine = lexicon.filter(S.is_well_formed(F.col("word")))
    return fine.select("word", F.explode(_delete_keys(max_edits)).alias("dk")).select("dk", "word")


def candidates(words: DataFrame, lexicon: DataFrame, max_edits: int = 2) -> DataFrame:
    """Distinct (query, word) that share a delete key: an equi-join instead of all pairs. One edit makes a smaller index.

    The keys are always shuffled: Spark takes the index to be about as large as the lexicon's files, and would broadcast it through the driver.
    """
    asked = words.select(F.col("word").alias("query"), F.explode(_delete_keys(max_edits)).alias("dk"))
    return asked.join(delete_index(lexicon, max_edits).hint("merge"), "dk").select("query", "word").distinct()


def unlisted(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word) of words that the lexicon doesn't have; the lexicon is shuffled, however small its files are."""
    return words.select("word").join(lexicon.select("word").hint("merge"), "word", "left_anti")


def frequency(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, freq) of words: 0 for one that the lexicon doesn't have."""
    return words.select("word").join(lexicon.select("word", "freq"), "word", "left").select("word", F.coalesce("freq", F.lit(0)).alias("freq"))


def rank(words: DataFrame, lexicon: DataFrame, limit: int = 5, max_edits: int = 2, places: int = 3) -> DataFrame:
    """(query, rank, word, cost): the nearest lexicon words, by cost, frequency and word; costs rounded to three places.

    Frequencies are joined to the pairs that are near enough, and by a shuffle: the lexicon's files are small, its words in a broadcast are not.
    """
    join = lambda c: F.array_join(S.unit_keys(F.col(c)), "")
    near = candidates(words, lexicon, max_edits).withColumn("d", distance(join("query"), join("word"))).filter(F.col("d") <= MAX_COST)
    scored = near.join(lexicon.hint("merge"), "word")
    w = Window.partitionBy("query").orderBy("d", F.desc("freq"), "word")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("query", "rank", "word", F.round("d", places).alias("cost"))


def check_words(words: DataFrame, lexicon: DataFrame, limit: int = 5) -> DataFrame:
    """(word, status, via, errors, suggestions) of distinct words; suggestions only where the status is a fault."""
    status = stored(word_status(words, lexicon), "status")
    bad = status.filter("status in ('structure', 'unknown')").select("word")
    best = stored(rank(bad, lexicon, limit), "ranked").groupBy(F.col("query").alias("word")).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("word").alias("w"), "cost"))).alias("s"))
    suggestions = F.transform(F.coalesce("s", F.array()), lambda x: F.struct(x.w.alias("word"), x.cost.alias("cost")))
    return status.join(best, "word", "left").select("word", "status", "via", _errors(), suggestions.alias("suggestions"))


def _errors() -> Column:
    """What is wrong with a malformed word; empty for any other status."""
    errors = S.explained(S.structure_errors(F.col("word")))
    return F.when(F.col("status") == "structure", errors).otherwise(F.slice(errors, 1, 0)).alias("errors")


def rerank(occurrences: DataFrame, ranked: DataFrame, bigrams: DataFrame, limit: int = 5) -> DataFrame:
    """Suggestions per occurrence (key columns, word, prev, next): known pairs with the neighbours earn a bonus each."""
    keys = [c for c in occurrences.columns]
    cand = occurrences.join(ranked.select(F.col("query").alias("word"), F.col("word").alias("cand"), F.col("rank").alias("r0"), "cost"), "word")
    left = bigrams.select(F.col("w1").alias("prev"), F.col("w2").alias("cand"), F.lit(1).alias("b1"))
    right = bigrams.select(F.col("w1").alias("cand"), F.col("w2").alias("next"), F.lit(1).alias("b2"))
    cand = cand.join(left, ["prev", "cand"], "left").join(right, ["cand", "next"], "left")
    cand = cand.withColumn("score", F.col("cost") - (F.when(F.col("b1").isNotNull(), BONUS).otherwise(0.0) + F.when(F.col("b2").isNotNull(), BONUS).otherwise(0.0)))
    w = Window.partitionBy(*keys).orderBy("score", "r0")
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select(*keys, "rank", "cand", "cost")


def with_neighbours(tokens: DataFrame, *keys: str) -> DataFrame:
    """tokens with prev and next, the words around, unless they have them already (see corpus.tokens)."""
    if {"prev", "next"} <= set(tokens.columns):
        return tokens
    w = Window.partitionBy(*keys).orderBy("pos")
    return tokens.withColumn("prev", F.lag("word").over(w)).withColumn("next", F.lead("word").over(w))


def context_errors(tokens: DataFrame, lexicon: DataFrame, bigrams: DataFrame, *keys: str, evidence: int = MIN_EVIDENCE) -> DataFrame:
    """keys, pos, word, start, end and alt: known words without any support from their neighbours
    whose like, one vowel length apart, is known and has at least `evidence`; the earliest of the best-supported.
    """
    occ = _known(with_neighbours(tokens, *keys), lexicon, "word")
    swap = F.expr(f"transform(filter(sequence(1, length(word)), i -> instr('{''.join(S.LENGTH_MAP)}', substring(word, i, 1)) > 0), i -> struct(i, overlay(word placing translate(substring(word, i, 1), '{''.join(S.LENGTH_MAP)}', '{''.join(S.LENGTH_MAP.values())}') from i) as alt))")
    per_word = occ.select("word").distinct().select("word", F.explode(swap).alias("s")).select("word", "s.i", "s.alt")
    per_word = stored(_known(per_word, lexicon, "alt").select("word", "i", "alt"), "alternatives")
    occ = occ.join(per_word.select("word").distinct(), "word", "left_semi")
    before = bigrams.select(F.col("w1").alias("prev"), F.col("w2").alias("x"), F.col("cnt").alias("c1"))
    after = bigrams.select(F.col("w1").alias("x"), F.col("w2").alias("next"), F.col("cnt").alias("c2"))
    support = lambda df: df.join(before, ["prev", "x"], "left").join(after, ["x", "next"], "left").withColumn("s", F.coalesce("c1", F.lit(0)) + F.coalesce("c2", F.lit(0))).drop("c1", "c2")
    alone = support(occ.withColumn("x", F.col("word"))).filter("s = 0").drop("s", "x")
    alt = support(alone.join(per_word, "word").withColumn("x", F.col("alt"))).filter(F.col("s") >= evidence)
    w = Window.partitionBy(*keys, "pos").orderBy(F.desc("s"), "i")
    return alt.withColumn("_no", F.row_number().over(w)).filter("_no = 1").select(*keys, "pos", "word", "start", "end", "alt")


def check_text(tokens: DataFrame, lexicon: DataFrame, bigrams: DataFrame, *keys: str) -> DataFrame:
    """keys, pos, word, start, end, status, errors (index, code and message) and suggestions (word and cost) of every issue.

    Tokens, faulty words and their suggestions are stored, as several branches read them: a plan that held every branch whole took most of the driver's memory.
    """
    tokens = stored(with_neighbours(tokens, *keys), "tokens")
    bad = stored(word_status(tokens.select("word"), lexicon).filter("status in ('structure', 'unknown')").select("word", "status"), "bad")
    occ = tokens.join(bad, "word")
    ranked = stored(rank(bad.select("word"), lexicon, limit=15), "ranked")
    best = rerank(occ.select(*keys, "pos", "word", "prev", "next"), ranked, bigrams)
    best = best.groupBy(*keys, "pos").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("cand").alias("word"), "cost"))).alias("s"))
    suggestions = F.transform(F.coalesce("s", F.array()), lambda x: F.struct(x.word.alias("word"), x.cost.alias("cost")))
    issues = occ.join(best, [*keys, "pos"], "left").select(*keys, "pos", "word", "start", "end", "status", _errors(), suggestions.alias("suggestions"))
    context = context_errors(tokens, lexicon, bigrams, *keys).withColumn("status", F.lit("context"))
    context = context.select(*keys, "pos", "word", "start", "end", "status", _errors(), F.array(F.struct(F.col("alt").alias("word"), F.lit(0.4).alias("cost"))).alias("suggestions"))
    return issues.unionByName(context)
