"""Readers and writers of the text formats: word lists, counts, thesaurus, definitions, dumps, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.corpus import upsert


def existing(spark: SparkSession, *paths: str) -> list[str]:
    """Those of some paths or patterns under which there is anything."""
    conf = spark._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        status = at.getFileSystem(conf).globStatus(at)
        if status is not None and len(status):
            found.append(path)
    return found


def _lines(spark: SparkSession, *paths: str) -> DataFrame:
    """value and no (unique, rising over the paths as given, the files by name and the lines of a file), without marks of order, comments and blank lines.

    Paths that don't exist are passed over.
    """
    rows = None
    for k, path in enumerate(existing(spark, *paths)):
        no = F.struct(F.lit(k).alias("k"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
        part = spark.read.text(path).select(F.regexp_replace("value", "^\\x{FEFF}", "").alias("value"), no.alias("no"))
        rows = part if rows is None else rows.union(part)
    if rows is None:
        rows = spark.createDataFrame([], "value string, no struct<k:int,file:string,block:long,line:long>")
    return rows.withColumn("value", F.regexp_replace("value", r"^\s+|\s+$", "")).filter("value <> '' and not startswith(value, '#')")


def word_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(word, freq) of all .tsv files of a folder, merged."""
    return word_list(spark, f"{folder.rstrip('/')}/*.tsv")


def word_list(spark: SparkSession, *paths: str) -> DataFrame:
    """(word, freq) of tab-separated lists, merged; a missing or odd second column counts as 1."""
    parts = F.split("value", "\t")
    freq = F.when(F.get(parts, F.lit(1)).rlike("^[0-9]+$"), F.get(parts, F.lit(1)).cast("long")).otherwise(F.lit(1).cast("long"))
    return upsert(_lines(spark, *paths).select(parts[0].alias("word"), freq.alias("freq")))


def counts(spark: SparkSession, *paths: str, pairs: bool = False, last_wins: bool = False) -> DataFrame:
    """(word, cnt) or (w1, w2, cnt) of count files; repeated keys are summed, or the last one stays."""
    keys = ["w1", "w2"] if pairs else ["word"]
    parts = F.split("value", "\t")
    rows = _lines(spark, *paths).filter(F.size(parts) == len(keys) + 1).select(*(parts[k].alias(c) for k, c in enumerate(keys)), F.try_to_number(parts[len(keys)], F.lit("9999999999999999")).cast("long").alias("cnt"), "no")
    return rows.groupBy(*keys).agg((F.max_by("cnt", "no") if last_wins else F.sum("cnt")).alias("cnt"))


def thesaurus(spark: SparkSession, path: str) -> DataFrame:
    """(word, ord, syn, cnt) of lines word, tab, syn:cnt|syn:cnt; a repeated word's last line stays, a missing count is 0."""
    parts = F.split("value", "\t")
    rows = _lines(spark, path).filter(F.size(parts) == 2).select(parts[0].alias("word"), parts[1].alias("syns"), "no")
    rows = rows.groupBy("word").agg(F.max_by("syns", "no").alias("syns")).select("word", F.posexplode(F.split("syns", r"\|")).alias("p", "s")).filter("s <> ''")
    has = F.col("s").contains(":")
    tail = F.regexp_extract("s", "([^:]*)$", 1)
    w = Window.partitionBy("word").orderBy("p")
    return rows.select("word", F.row_number().over(w).alias("ord"), F.when(has, F.regexp_extract("s", "(?s)^(.*):[^:]*$", 1)).otherwise(F.col("s")).alias("syn"), F.when(has & tail.rlike("^[0-9]+$"), tail.cast("long")).otherwise(F.lit(0).cast("long")).alias("cnt"))


def definitions(spark: SparkSession, path: str) -> DataFrame:
    """(head, sense_no, sense): split at the first tab, senses in file order."""
    rows = _lines(spark, path).filter(F.col("value").contains("\t")).select(F.split("value", "\t", 2).alias("p"), "no")
    w = Window.partitionBy("head").orderBy("no")
    return rows.select(F.col("p")[0].alias("head"), F.col("p")[1].alias("sense"), "no").select("head", F.row_number().over(w).alias("sense_no"), "sense")


def array_dump(spark: SparkSession, path: str) -> DataFrame:
    """(head, sense) of a script file that assigns a JSON array of pairs; white space in a sense is collapsed, blank ones go."""
    body = F.regexp_extract("value", r"(?s)=\s*(\[.*\])\s*;", 1)
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(body, "array<array<string>>")).alias("e"))
    return rows.select(F.trim(F.col("e")[0]).alias("head"), F.trim(F.regexp_replace(F.col("e")[1], r"\s+", " ")).alias("sense")).filter("head <> '' and sense <> ''")


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """text of each page of a (compressed) wiki dump, by the built-in XML reader."""
    schema = "title string, revision struct<text: struct<_VALUE: string>>"
    return spark.read.format("xml").option("rowTag", "page").schema(schema).load(path).select(F.col("revision.text._VALUE").alias("text"))


def page_files(spark: SparkSession, folder: str) -> DataFrame:
    """name and text of the .html and .txt files of a folder."""
    read = spark.read.text(folder, wholetext=True, pathGlobFilter="*.{html,txt}", recursiveFileLookup=True)
    return read.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("text"))


def page_name(url: str):
    """The file name that a fetched page is kept under."""
    return F.concat(F.substring(F.sha1(F.col(url)), 1, 16), F.lit(".html"))


def write_tsv(df: DataFrame, path: str, *order: str) -> None:
    """Tab-separated files, globally ordered; a column name with a leading - sorts downwards."""
    keys = [F.desc(c[1:]) if c.startswith("-") else F.col(c) for c in order]
    df.orderBy(*keys).write.csv(path, sep="\t", quote="", escape="")


def write_noted(df: DataFrame, path: str, note: str, *order: str) -> None:
    """Tab-separated lines, globally ordered, after a line with a note; files read in the order of their names are one text."""
    keys = [F.desc(c[1:]) if c.startswith("-") else F.col(c) for c in order]
    lines = df.select(F.lit(1).alias("o"), F.concat_ws("\t", *(F.col(c).cast("string") for c in df.columns)).alias("line"), *df.columns)
    first = df.sparkSession.range(1).select(F.lit(0).alias("o"), F.lit(f"# {note}").alias("line"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema))
    first.union(lines).orderBy("o", *keys).select("line").write.text(path)


def write_lexicon(lexicon: DataFrame, path: str, note: str) -> None:
    """word and freq by word."""
    write_noted(lexicon.select("word", "freq"), path, note, "word")


def write_counts(counts: DataFrame, path: str, note: str, least: int = 3, most: int = 100_000) -> None:
    """Words or pairs counted at least so often, by falling count; word counts are capped."""
    keys = [c for c in counts.columns if c != "cnt"]
    cnt = F.least("cnt", F.lit(most)) if keys == ["word"] else F.col("cnt")
    write_noted(counts.filter(F.col("cnt") >= least).select(*keys, cnt.alias("cnt")), path, note, "-cnt", *keys)


def write_thesaurus(thesaurus: DataFrame, path: str) -> None:
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("syn", "cnt"))), lambda x: F.concat_ws(":", x.syn, x.cnt.cast("string"))), "|")
    write_tsv(thesaurus.groupBy("word").agg(line.alias("line")), path, "word")


def append_words(words: DataFrame, path: str, freq: int = 50) -> None:
    """Add words to a user's list."""
    words.select("word", F.lit(freq)).write.mode("append").csv(path, sep="\t", quote="", escape="")
