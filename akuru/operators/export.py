"""Spelling dictionary files and service messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import script as S
from .morphology import RULES


def replacement_pairs() -> list[tuple[str, str]]:
    """Length pairs, then all ordered pairs within the confusion sets, in order and once each."""
    pairs = [*S.LENGTH_MAP.items(), *((a, b) for g in S.CONFUSION_SETS for a in sorted(g) for b in sorted(g) if a != b)]
    return list(dict.fromkeys(pairs))


def rep_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(replacement_pairs())], "no int, a string, b string")


def try_characters(frequencies: DataFrame) -> DataFrame:
    """One row: the characters of (ch, cnt) by falling count, then by code point."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("c"), "ch")))
    return frequencies.agg(F.array_join(F.transform(order, lambda x: x.ch), "").alias("try"))


def suffix_lines(spark: SparkSession, flag: str = "A") -> DataFrame:
    """The affix file's suffix rules, numbered; 0 stands for nothing to strip, . for any ending."""
    kinds = ["nominal", "verb", "eve"]
    rows = [(k, r[2], r[3]) for k, r in enumerate(sorted(RULES, key=lambda r: (kinds.index(r[0]), r[1])))]
    return spark.createDataFrame(rows, "no int, strip string, append string").select("no", F.format_string(f"SFX {flag} %s %s %s", F.when(F.col("strip") == "", "0").otherwise(F.col("strip")), F.col("append"), F.when(F.col("strip") == "", ".").otherwise(F.col("strip"))).alias("line"))


def affix_lines(lexicon: DataFrame, frequencies: DataFrame, flag: str = "A") -> list[str]:
    """The whole affix file, a few hundred lines."""
    spark = lexicon.sparkSession
    chars = try_characters(frequencies).first()["try"]
    letters = "".join(map(chr, [*range(0x0780, 0x07A6), 0x07B1, *range(0x07A6, 0x07B1)]))
    suffixes = [r.line for r in suffix_lines(spark, flag).orderBy("no").collect()]
    reps = replacement_pairs()
    return ["SET UTF-8", f"WORDCHARS {letters}", "", f"TRY {chars}", "", f"REP {len(reps)}", *(f"REP {a} {b}" for a, b in reps), "", f"SFX {flag} Y {len(suffixes)}", *suffixes]


def write_dictionary(lexicon: DataFrame, path: str, flag: str = "A") -> None:
    """A folder with the count and the sorted, flagged words in one text file, as the format asks."""
    n = lexicon.count()
    spark = lexicon.sparkSession
    lines = spark.createDataFrame([(0, str(n))], "o int, value string").union(lexicon.select(F.lit(1), F.concat("word", F.lit(f"/{flag}"))))
    lines.orderBy("o", "value").coalesce(1).select("value").write.text(path)


def bundle(lexicon: DataFrame) -> DataFrame:
    """(no, line): word, tab, frequency, in word order."""
    return lexicon.select("word", F.concat_ws("\t", "word", F.col("freq").cast("string")).alias("line"))


def write_bundle(lexicon: DataFrame, path: str, name: str = "LEXICON") -> None:
    """A folder whose text files, read in order, are a script that holds the lexicon's lines in one string."""
    ends = lexicon.sparkSession.createDataFrame([(0, f"const {name} = `"), (2, "`;")], "o int, value string")
    escaped = F.regexp_replace("line", r"([\\\\`$])", r"\\\\$1")
    ends.union(bundle(lexicon).select(F.lit(1), escaped)).orderBy("o", "value").select("value").write.text(path)


def matches(spelling: DataFrame, grammar: DataFrame, *keys: str) -> DataFrame:
    """keys, no, offset and match, a JSON message per issue in the form editors' plug-ins read.

    Messages are numbered by offset, spelling before grammar, each in its own order.
    """
    size = (F.col("end") - F.col("start")).alias("length")
    kind = lambda t, n: F.struct(F.lit(t).alias("id"), F.lit(n).alias("name")).alias("category")
    told = F.when(F.col("status") == "structure", "Thaana structure error").otherwise("Unknown word")
    values = F.transform(F.col("suggestions"), lambda s: F.struct(s.word.alias("value")))
    rule = F.struct(F.concat(F.lit("DV_SPELL_"), F.upper("status")).alias("id"), F.lit("Dhivehi spelling").alias("description"), F.lit("misspelling").alias("issueType"), kind("TYPOS", "Spelling"))
    s = spelling.select(*keys, F.lit(0).alias("o"), F.col("pos").alias("p"), told.alias("message"), F.lit("Spelling").alias("shortMessage"), F.col("start").alias("offset"), size, values.alias("replacements"), rule.alias("rule"))
    one = F.when(F.col("replacement").isNotNull(), F.array(F.struct(F.col("replacement").alias("value")))).otherwise(F.array().cast("array<struct<value:string>>"))
    sort = F.when(F.col("severity") == "style", "style").otherwise("grammar")
    rule = F.struct(F.concat(F.lit("DV_"), F.upper(F.translate("rule", "-", "_"))).alias("id"), F.col("message").alias("description"), sort.alias("issueType"), kind("GRAMMAR", "Grammar"))
    g = grammar.select(*keys, F.lit(1).alias("o"), F.col("no").alias("p"), "message", F.col("rule").alias("shortMessage"), F.col("start").alias("offset"), size, one.alias("replacements"), rule.alias("rule"))
    w = Window.partitionBy(*keys).orderBy("offset", "o", "p")
    both = s.unionByName(g).withColumn("no", F.row_number().over(w))
    return both.select(*keys, "no", "offset", F.to_json(F.struct("message", "shortMessage", "offset", "length", "replacements", "rule")).alias("match"))
