"""Quality of the checker on made errors: every corruption of every word, or a seeded weighted draw."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import script as S

PLAIN_FILI = "".join(S.LENGTH_MAP)
GATE = {"detected": 92.0, "top1": 82.0, "false_positives": 0.5}


def pool(lexicon: DataFrame) -> DataFrame:
    """Words to corrupt: frequency 3 or more, three units or more (the lexicon is well formed)."""
    return lexicon.filter((F.col("freq") >= 3) & (F.size(S.chunks(F.col("word"))) >= 3))


def corruptions(words: DataFrame) -> DataFrame:
    """Distinct (word, kind, wrong): dropped final sukun, another vowel sign, a like-sounding consonant, a unit less, neighbours swapped."""
    c = words.select("word", S.chunks(F.col("word")).alias("c"))
    at = c.select("word", "c", F.posexplode("c").alias("i", "u"))
    put = lambda new: F.array_join(F.transform("c", lambda x, j: F.when(j == F.col("i"), new).otherwise(x)), "")
    fili = F.when(F.length("u") == 2, F.right("u", F.lit(1)))
    signs = F.filter(F.array(*map(F.lit, PLAIN_FILI)), lambda f: f != fili)
    swaps = at.filter(fili.isNotNull() & (fili != S.SUKUN)).withColumn("f", F.explode(signs)).select("word", F.lit("fili-swap").alias("kind"), put(F.concat(F.left("u", F.lit(1)), F.col("f"))).alias("wrong"))
    first = F.left("u", F.lit(1))
    like = F.array().cast("array<string>")
    for group in S.CONFUSION_SETS:
        for ch in group:
            like = F.when(first == ch, F.array(*(F.lit(x) for x in group if x != ch))).otherwise(like)
    sounds = at.withColumn("l", F.explode(like)).select("word", F.lit("confusion").alias("kind"), put(F.concat("l", F.expr("substring(u, 2)"))).alias("wrong"))
    less = at.select("word", F.lit("delete-unit").alias("kind"), F.array_join(F.filter("c", lambda x, j: j != F.col("i")), "").alias("wrong"))
    turned = at.filter(F.col("i") < F.size("c") - 1).select("word", F.lit("transpose").alias("kind"), F.array_join(F.transform("c", lambda x, j: F.when(j == F.col("i"), F.get("c", j + 1)).when(j == F.col("i") + 1, F.get("c", j - 1)).otherwise(x)), "").alias("wrong"))
    bare = words.filter(F.col("word").endswith(S.SUKUN)).select("word", F.lit("drop-sukun").alias("kind"), F.expr("left(word, length(word) - 1)").alias("wrong"))
    return swaps.union(sounds).union(less).union(turned).union(bare).filter("wrong <> word").distinct()


def sample(words: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n words drawn without replacement with odds by frequency: the least of -ln(u) / freq, u from a seeded hash."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "word")), 1, 12), 16, 10).cast("double") + 1) / float(16**12 + 1)
    return words.withColumn("_k", -F.log(u) / F.col("freq")).orderBy("_k", "word").limit(n).drop("_k")


#: Buckets of words whose total frequencies the driver reads to place the draws.
BUCKETS = 256


def _bucket(word: Column) -> Column:
    return F.conv(F.substring(F.md5(word), 1, 4), 16, 10).cast("int") % BUCKETS


def draws(words: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(draw, word): n words drawn with replacement with odds by frequency.

    Draw k falls on the place md5(seed:k) modulo the total frequency, in words ordered by bucket
    and word. The driver reads one total per bucket; the words of a bucket are summed up in one task.
    """
    spark = words.sparkSession
    put = words.select("word", "freq", _bucket(F.col("word")).alias("b"))
    totals = {r["b"]: r["f"] for r in put.groupBy("b").agg(F.sum("freq").alias("f")).collect()}
    starts, total = {}, 0
    for b in sorted(totals):
        starts[b] = total
        total += totals[b]
    places = []
    for k in range(n if total else 0):
        at = int(hashlib.md5(f"{seed}:{k}".encode()).hexdigest()[:12], 16) % total
        b = max(b for b in starts if starts[b] <= at)
        places.append((k, b, at - starts[b]))
    asked = spark.createDataFrame(places, "draw int, b int, at long")
    w = Window.partitionBy("b").orderBy("word")
    ends = put.withColumn("end", F.sum("freq").over(w))
    return ends.join(F.broadcast(asked), "b").filter((F.col("at") < F.col("end")) & (F.col("at") >= F.col("end") - F.col("freq"))).select("draw", "word")


def trials(lexicon: DataFrame, n: int = 500, seed: int = 42) -> DataFrame:
    """(draw, word, kind, wrong): one corruption each of words drawn by frequency, the first n that give one.

    Corruptions that are lexicon words themselves don't count. Of the others of a word a hash
    picks the kind first, then the corruption.
    """
    some = draws(pool(lexicon), n + n // 2, seed)
    made = corruptions(some.select("word").distinct()).join(lexicon.select(F.col("word").alias("wrong")), "wrong", "left_anti")
    h = lambda *c: F.md5(F.concat_ws(":", F.lit(str(seed)), *c))
    k = F.col("draw").cast("string")
    w = Window.partitionBy("draw").orderBy(h(k, "kind"), "kind", h(k, "kind", "wrong"), "wrong")
    one = some.join(made, "word").withColumn("_no", F.row_number().over(w)).filter("_no = 1")
    return one.select("draw", "word", "kind", "wrong").orderBy("draw").limit(n)


def summary(made: DataFrame, status: DataFrame, ranked: DataFrame) -> DataFrame:
    """kind, n, detected, top1 and top5 of corruptions (word, kind, wrong), and a TOTAL row."""
    caught = status.select(F.col("word").alias("wrong"), F.col("status").isin("structure", "unknown").alias("d"))
    found = ranked.filter("rank <= 5").select(F.col("query").alias("wrong"), "word", "rank")
    rows = made.join(caught, "wrong").join(found, ["wrong", "word"], "left")
    hit = lambda k: F.sum((F.col("d") & F.coalesce(F.col("rank") <= k, F.lit(False))).cast("long"))
    out = rows.rollup("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("d").cast("long")).alias("detected"), hit(1).alias("top1"), hit(5).alias("top5"))
    return out.select(F.coalesce("kind", F.lit("TOTAL")).alias("kind"), "n", "detected", "top1", "top5")


def false_positives(clean: DataFrame, status: DataFrame) -> DataFrame:
    """A row in summary()'s columns: how many clean words there are, and how many of them count as faults."""
    rows = clean.select("word").join(status, "word")
    wrong = F.coalesce(F.sum(F.col("status").isin("structure", "unknown").cast("long")), F.lit(0))
    return rows.agg(F.count(F.lit(1)).alias("n"), wrong.alias("detected")).select(F.lit("FALSE_POSITIVES").alias("kind"), "n", "detected", F.lit(0).cast("long").alias("top1"), F.lit(0).cast("long").alias("top5"))


def passes(detected: float, top1: float, false_positives: float) -> bool:
    """Whether percentages meet the gate."""
    return detected >= GATE["detected"] and top1 >= GATE["top1"] and false_positives <= GATE["false_positives"]
