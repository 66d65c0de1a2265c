"""Inflection by rules: forms from stems, and known stems from forms, as joins on word endings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Kind, number, ending that is removed, ending that is appended.
RULES = [
    ("nominal", 0, "ް", "ުގައި"), ("nominal", 1, "ް", "ުގެ"), ("nominal", 2, "ް", "ުން"), ("nominal", 3, "ް", "ަށް"),
    ("nominal", 4, "ް", "ެއް"), ("nominal", 5, "ް", "ަކީ"), ("nominal", 6, "ް", "ަކަށް"), ("nominal", 7, "ް", "ަކުން"),
    ("nominal", 8, "ް", "ަކު"), ("nominal", 9, "ް", "ާ"), ("nominal", 10, "ް", "ާއި"), ("nominal", 11, "ސް", "ހުގައި"),
    ("nominal", 12, "ސް", "ހުގެ"), ("nominal", 13, "ސް", "ހުން"), ("nominal", 14, "ސް", "ހަށް"), ("nominal", 15, "ސް", "ހެއް"),
    ("nominal", 16, "ސް", "ހަކީ"), ("nominal", 17, "ސް", "ހަކަށް"), ("nominal", 18, "ސް", "ހަކުން"), ("nominal", 19, "ސް", "ހަކު"),
    ("nominal", 20, "ސް", "ހާ"), ("nominal", 21, "ސް", "ހާއި"), ("nominal", 22, "ން", "މުގައި"), ("nominal", 23, "ން", "މުގެ"),
    ("nominal", 24, "ން", "މުން"), ("nominal", 25, "ން", "މަށް"), ("nominal", 26, "ން", "މެއް"), ("nominal", 27, "ން", "މަކީ"),
    ("nominal", 28, "ން", "މަކަށް"), ("nominal", 29, "ން", "މަކުން"), ("nominal", 30, "ން", "މަކު"), ("nominal", 31, "ން", "މާ"),
    ("nominal", 32, "ން", "މާއި"), ("nominal", 33, "ު", "ުގައި"), ("nominal", 34, "ު", "ުގެ"), ("nominal", 35, "ު", "ުން"),
    ("nominal", 36, "ު", "ަށް"), ("nominal", 37, "ު", "ެއް"), ("nominal", 38, "ު", "ަކީ"), ("nominal", 39, "ު", "ަކަށް"),
    ("nominal", 40, "ު", "ަކުން"), ("nominal", 41, "ު", "ަކު"), ("nominal", 42, "ު", "ާ"), ("nominal", 43, "ު", "ާއި"),
    ("nominal", 44, "ި", "ީގައި"), ("nominal", 45, "ި", "ީގެ"), ("nominal", 46, "ި", "ިން"), ("nominal", 47, "ި", "ީން"),
    ("nominal", 48, "ަ", "ައިގެ"), ("nominal", 49, "ަ", "ައިގައި"), ("nominal", 50, "ަ", "ައިން"), ("nominal", 51, "ަ", "ައަށް"),
    ("nominal", 52, "ަ", "ައެއް"), ("nominal", 53, "ަ", "ައަކީ"), ("nominal", 54, "ަ", "ައަކަށް"), ("nominal", 55, "ަ", "ައަކުން"),
    ("nominal", 56, "ަ", "ައަކު"), ("nominal", 57, "ެ", "ޭގެ"), ("nominal", 58, "ެ", "ޭގައި"), ("nominal", 59, "ެ", "ެއަށް"),
    ("nominal", 60, "ެ", "ެއެއް"), ("nominal", 61, "ެ", "ެއިން"), ("nominal", 62, "ެ", "ެއަކީ"), ("nominal", 63, "ާ", "ާގެ"),
    ("nominal", 64, "ާ", "ާގައި"), ("nominal", 65, "ާ", "ާއަށް"), ("nominal", 66, "ާ", "ާއެއް"), ("nominal", 67, "ާ", "ާއިން"),
    ("nominal", 68, "ީ", "ީގެ"), ("nominal", 69, "ީ", "ީގައި"), ("nominal", 70, "ީ", "ީއަށް"), ("nominal", 71, "ީ", "ީއެއް"),
    ("nominal", 72, "ީ", "ީއިން"), ("nominal", 73, "ޫ", "ޫގެ"), ("nominal", 74, "ޫ", "ޫގައި"), ("nominal", 75, "ޫ", "ޫއަށް"),
    ("nominal", 76, "ޫ", "ޫއެއް"), ("nominal", 77, "ޫ", "ޫއިން"), ("nominal", 78, "ޭ", "ޭގެ"), ("nominal", 79, "ޭ", "ޭގައި"),
    ("nominal", 80, "ޭ", "ޭއަށް"), ("nominal", 81, "ޭ", "ޭއެއް"), ("nominal", 82, "ޭ", "ޭއިން"), ("nominal", 83, "ޯ", "ޯގެ"),
    ("nominal", 84, "ޯ", "ޯގައި"), ("nominal", 85, "ޯ", "ޯއަށް"), ("nominal", 86, "ޯ", "ޯއެއް"), ("nominal", 87, "ޯ", "ޯއިން"),
    ("nominal", 88, "", "ތައް"), ("nominal", 89, "", "ތަކުގެ"), ("nominal", 90, "", "ތަކުގައި"), ("nominal", 91, "", "ތަކަށް"),
    ("nominal", 92, "", "ތަކުން"), ("nominal", 93, "", "ތަކެއް"), ("nominal", 94, "", "ތަކަކީ"), ("nominal", 95, "", "ތަކަކަށް"),
    ("verb", 0, "ުން", "ަނީ"), ("verb", 1, "ުން", "ަން"), ("verb", 2, "ުން", "ި"), ("verb", 3, "ުން", "ީ"),
    ("verb", 4, "ުން", "ާ"), ("verb", 5, "ުން", "ާނެ"), ("verb", 6, "ުން", "ާނީ"), ("verb", 7, "ުން", "ޭ"),
    ("verb", 8, "ުން", "ަމުން"), ("verb", 9, "ުން", "ެވޭ"), ("verb", 10, "ުން", "ެވުނު"), ("verb", 11, "ުން", "ެވުން"),
    ("verb", 12, "ުން", "ުވުން"), ("verb", 13, "ުން", "ާތީ"), ("verb", 14, "ުން", "ިއްޖެ"), ("eve", 0, "", "އެވެ"),
    ("eve", 1, "ް", "ެވެ"), ("eve", 2, "އި", "އެވެ"),
]
LONGEST = max(len(r[3]) for r in RULES)


def rules(spark: SparkSession, *kinds: str) -> DataFrame:
    """The rule table; a hundred-odd rows, broadcast in joins."""
    return spark.createDataFrame([r for r in RULES if r[0] in kinds], "kind string, rule_no int, remove string, append string")


def generate(stems: DataFrame, *kinds: str) -> DataFrame:
    """Distinct (stem, form) for each rule whose ending the stem has, but for the stem itself."""
    r = rules(stems.sparkSession, *kinds)
    cut = stems.select("stem", F.explode(F.array(*(F.right("stem", F.lit(k)) for k in range(1, 4)), F.lit(""))).alias("remove")).distinct()
    out = cut.join(F.broadcast(r), "remove").withColumn("base", F.expr("left(stem, length(stem) - length(remove))"))
    return out.filter("length(base) >= 1").select("stem", F.concat("base", "append").alias("form")).filter("form <> stem").distinct()


def invert(words: DataFrame, *kinds: str) -> DataFrame:
    """words with kind, rule_no and stem for each rule that could have made the word; an equi-join on its endings."""
    ends = words.withColumn("append", F.explode(F.expr(f"transform(sequence(1, least(length(word), {LONGEST})), k -> right(word, k))")))
    out = ends.join(F.broadcast(rules(words.sparkSession, *kinds)), "append").withColumn("stem", F.expr("concat(left(word, length(word) - length(append)), remove)"))
    return out.filter("length(stem) >= 2 and stem <> word").drop("append", "remove")


def stems(words: DataFrame) -> DataFrame:
    """(word, phase, rule_no, stem): nominal, verb, the particle, and both below the particle."""
    first = invert(words.select("word").filter("word <> ''"), "nominal", "verb", "eve")
    phase = F.when(F.col("kind") == "nominal", 1).when(F.col("kind") == "verb", 2).otherwise(3)
    below = invert(first.filter("kind = 'eve'").select(F.col("word").alias("whole"), F.col("stem").alias("word")), "nominal", "verb")
    deep = below.select(F.col("whole").alias("word"), F.when(F.col("kind") == "nominal", 4).otherwise(5).alias("phase"), "rule_no", "stem")
    return first.select("word", phase.alias("phase"), "rule_no", "stem").union(deep)


def analyze(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, stem, rank): the known stems of each word, in order of phase, rule and stem."""
    known = stems(words).join(lexicon.select(F.col("word").alias("stem")), "stem", "left_semi")
    best = known.groupBy("word", "stem").agg(F.min(F.struct("phase", "rule_no")).alias("o"))
    w = Window.partitionBy("word").orderBy("o.phase", "o.rule_no", "stem")
    return best.select("word", "stem", F.row_number().over(w).alias("rank"))
