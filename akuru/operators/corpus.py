"""Corpus tables: token rows, counts, the derived lexicon, harvested entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import script as S
from ..functions.batches import counted as batches_counted
from ..functions.udfs import single_word

MIN_COUNT, MAX_FREQ = 3, 100_000


def thaana(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys and t, the transliterated text; a null text is empty.

    An input with fewer splits than cores is dealt out first, as the work per character is what takes time.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    df = df.select(*keys, text)
    if df._jdf.rdd().getNumPartitions() < cores:
        df = df.repartition(cores)
    return df.select(*keys, S.latin_to_thaana(F.coalesce(F.col(text), F.lit(""))).alias("t"))


def tokens(df: DataFrame, *keys: str, neighbours: bool = False) -> DataFrame:
    """A row per word of t: keys, pos (from 0), word, start and end in code points; on request prev and next, the words around.

    All is worked out within the text's own row, so nothing is shuffled and texts with equal keys
    stay apart. Offsets count zero-width joiners, words leave them out.
    """
    each = S.located_words(F.col("t"))
    if neighbours:
        each = S.let(each, lambda a: F.transform(a, lambda x, i: F.struct(x.word.alias("word"), x.start.alias("start"), x.end.alias("end"), F.get(a, i - 1).word.alias("prev"), F.get(a, i + 1).word.alias("next"))))
    return df.select(*keys, F.posexplode(each).alias("pos", "x")).select(*keys, "pos", "x.*")


def unigrams(df: DataFrame) -> DataFrame:
    return df.select(F.explode(S.words(F.col("t"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def bigrams(df: DataFrame) -> DataFrame:
    """Neighbouring words of one text, made in the row, so that only counted pairs are shuffled."""
    pairs = S.let(S.words(F.col("t")), lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.struct(x.alias("w1"), F.get(w, i + 1).alias("w2"))))
    return df.select(F.explode(pairs).alias("p")).groupBy("p.w1", "p.w2").agg(F.count(F.lit(1)).alias("cnt"))


def counted(df: DataFrame, text: str = "text") -> DataFrame:
    """(w1, w2, cnt): bigrams() of the transliterated texts and, with an empty w2, unigrams(), in one pass over Arrow batches.

    Pairs are counted for millions of words before they are sent on, all that follow a word in one row.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    df = df.select(text)
    if df._jdf.rdd().getNumPartitions() < cores:
        df = df.repartition(cores)
    schema = T.StructType().add("w1", "string").add("w2s", "string").add("cnts", T.ArrayType(T.LongType()))
    rows = df.mapInArrow(lambda batches: batches_counted(batches, to_arrow_schema(schema)), schema).repartition("w1")
    each = rows.select("w1", F.explode(F.arrays_zip(F.split("w2s", " ", -1).alias("w2"), F.col("cnts").alias("cnt"))).alias("x"))
    return each.groupBy("w1", "x.w2").agg(F.sum("x.cnt").alias("cnt"))


def derived_lexicon(counts: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, freq) from (word, cnt): frequent, two code points at least, well formed, frequency capped."""
    kept = counts.filter((F.col("cnt") >= min_count) & (F.length("word") >= 2)).filter(S.is_well_formed(F.col("word")))
    return kept.select("word", F.least("cnt", F.lit(MAX_FREQ)).cast("long").alias("freq"))


def upsert(*lexicons: DataFrame) -> DataFrame:
    """Merge (word, freq) tables; the larger frequency of a word stays, blank words go."""
    merged = lexicons[0]
    for more in lexicons[1:]:
        merged = merged.unionByName(more)
    return merged.withColumn("word", F.trim("word")).filter("word <> ''").groupBy("word").agg(F.max("freq").alias("freq"))


def merge_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum of two count tables with the same key columns."""
    keys = [c for c in a.columns if c != "cnt"]
    return a.unionByName(b).groupBy(*keys).agg(F.sum("cnt").alias("cnt"))


def new_words(lexicon: DataFrame, known: DataFrame) -> DataFrame:
    return lexicon.join(known.select("word"), "word", "left_anti")


def char_frequency(words: DataFrame) -> DataFrame:
    return words.select(F.explode(F.split("word", "")).alias("ch")).filter("ch <> ''").groupBy("ch").agg(F.count(F.lit(1)).alias("cnt"))


def harvest_headwords(entries: DataFrame) -> DataFrame:
    """(word, freq) from (head): 50 for a one-word head, 30 for words of longer ones, 20 if malformed; the most counts."""
    parts = entries.select(S.words(F.col("head")).alias("w")).select(F.size("w").alias("n"), F.explode("w").alias("word")).filter(F.length("word") >= 2)
    freq = F.when(~S.is_well_formed(F.col("word")), 20).when(F.col("n") == 1, 50).otherwise(30).cast("long")
    return parts.select("word", freq.alias("freq")).groupBy("word").agg(F.max("freq").alias("freq"))


def harvest_synonyms(entries: DataFrame) -> DataFrame:
    """Distinct (word, syn), both ways, from (head, sense) whose head and bare sense are one word each, and differ."""
    pairs = entries.select(single_word(F.col("head"), F.lit(False)).alias("word"), single_word(F.col("sense"), F.lit(True)).alias("syn")).filter("word <> syn")
    both = F.array(F.struct("word", "syn"), F.struct(F.col("syn").alias("word"), F.col("word").alias("syn")))
    return pairs.select(F.explode(both).alias("x")).select("x.*").distinct()


def clean_markup(text: Column) -> Column:
    """Templates (two levels), references, tags, links and entities out of wiki markup."""
    for pattern, new in CLEAN_MARKUP:
        text = F.regexp_replace(text, pattern, new.replace("\\1", "$1"))
    return text


#: Patterns and replacements, in order.
CLEAN_MARKUP = ((r"(?s)\{\{[^{}]*\}\}", " "), (r"(?s)\{\{[^{}]*\}\}", " "), (r"(?s)<ref[^>]*>.*?</ref>", " "), (r"<[^>]+>", " "), (r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "\\1"), (r"&[a-z]+;", " "))
