"""Quality rules with host-level verdicts, in built-in functions only.

Every document is measured in its own row (nothing is exploded), the failures of each rule are
counted per host with map-side combination, the failure rates are shrunk towards an empirical
beta prior per rule, and the host verdicts are joined back: a host that fails a rule far more
often than hosts do loses all its documents, and on one that hardly ever fails a rule a
document's lone failure of it is forgiven. Repeated three-word windows are found through their
64-bit hashes within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, materialize, words

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Hosts up to this number are sent to every executor (about 50 bytes each); more are joined by a shuffle.
BROADCAST_HOSTS = 50_000


def measure(text: str = "text") -> Column:
    """A struct with a long per name of METRICS, for one text.

    A null or empty text has no words, and all its metrics are zero. Texts of any length are
    measured whole.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))

    def windows(w: Column) -> Column:
        hashes = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return F.slice(hashes, 1, F.greatest(F.size(w) - 2, F.lit(0)))

    def covered(h: Column) -> Column:
        """Positions in windows whose hash occurs twice; the hashes are only sorted if one does."""
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twice = lambda x, j: (x.h == F.get(s, j - 1).h) | (x.h == F.get(s, j + 1).h)
            return F.filter(F.transform(s, lambda x, j: F.when(F.coalesce(twice(x, j), F.lit(False)), x.i).otherwise(-1)), lambda x: x >= 0)

        spread = lambda s: F.size(F.array_distinct(F.flatten(F.transform(starts(s), lambda x: F.array(x, x + 1, x + 2)))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(placed, spread))

    def of_words(w: Column) -> list[Column]:
        return [F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), let(windows(w), covered).alias("n_repeat_words")]

    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    by_word = let(words(F.col(text)), lambda w: F.struct(*of_words(w)))
    symbols = F.length(t) - F.length(F.translate(t, SYMBOLS, ""))
    values = {"n_words": lambda w, x: w.n_words, "word_chars": lambda w, x: w.word_chars, "n_symbols": lambda w, x: symbols, "n_dup_lines": lambda w, x: x.dup, "n_repeat_words": lambda w, x: w.n_repeat_words, "n_lines": lambda w, x: x.n}
    return let(by_word, lambda w: let(by_line, lambda x: F.struct(*(values[k](w, x).cast("long").alias(k) for k in METRICS))))


#: Rules, and the bit of each in a document's failures. The first two are the base rules.
RULES = ("short", "repeats", "symbols", "lines")
SOFT = ("symbols", "lines")
#: A host is rejected if its shrunk rate of a rule is above MAX_RATE and above BEYOND times the hosts' mean.
MAX_RATE, BEYOND = 0.3, 2.0
#: A host is trusted with a soft rule if its shrunk rate is below this share of the hosts' mean.
TRUST = 0.5


def failures(m: Column) -> Column:
    """The rules a document fails, as bits: fewer than 50 words; more than half of the words in repeated
    windows; more than one symbol in ten words; three lines or more that repeat earlier ones and
    make up over three tenths.
    """
    failed = (m.n_words < 50, 100 * m.n_repeat_words > 50 * m.n_words, 10 * m.n_symbols > m.n_words, (m.n_dup_lines >= 3) & (10 * m.n_dup_lines > 3 * m.n_lines))
    bits = [F.when(x, 1 << k).otherwise(0) for k, x in enumerate(failed)]
    return sum(bits[1:], bits[0])


def fails(rule: str, bits: str = "fails") -> Column:
    return F.col(bits).bitwiseAND(F.lit(1 << RULES.index(rule))) != 0


def host_verdicts(judged: DataFrame) -> DataFrame:
    """From rows (host, fails), one row per host: host_null, host_name, n, and per rule the failures f_<rule>
    and the shrunk rate r_<rule>; host_ok, and trust_<rule> for the soft rules.

    A rule's prior has the mean of the hosts' rates and, by moments, the strength that their
    spread beyond sampling leaves; without any such spread the strength is its largest value, so that every
    host gets the mean. A host's rate is (failed + strength * mean) / (n + strength). An empty
    table gives no rows. A null host is a host of its own.
    """
    hosts = (
        judged.groupBy(F.col("host").isNull().alias("host_null"), F.coalesce(F.col("host").cast("string"), F.lit("")).alias("host_name"))
        .agg(F.count(F.lit(1)).alias("n"), *(F.sum(fails(r).cast("long")).alias(f"f_{r}") for r in RULES))
    )
    hosts = materialize(hosts, "quality-hosts")
    means = hosts.agg(*(F.avg(F.col(f"f_{r}") / F.col("n")).alias(r) for r in RULES)).first()
    mean = {r: means[r] or 0.0 for r in RULES}
    spread = {r: F.var_pop(F.col(f"f_{r}") / F.col("n")) - F.avg(F.lit(mean[r] * (1 - mean[r])) / F.col("n")) for r in RULES}
    spreads = hosts.agg(*(F.coalesce(v, F.lit(0.0)).alias(r) for r, v in spread.items())).first()
    bad, trust = F.lit(False), []
    for r in RULES:
        strength = min(max(mean[r] * (1 - mean[r]) / spreads[r] - 1, 1.0), 1e6) if spreads[r] > 1e-12 else 1e6
        hosts = hosts.withColumn(f"r_{r}", F.round((F.col(f"f_{r}") + F.lit(strength * mean[r])) / (F.col("n") + F.lit(strength)), 9))
        bad = bad | ((F.col(f"r_{r}") > MAX_RATE) & (F.col(f"r_{r}") > BEYOND * mean[r]))
        if r in SOFT:
            trust.append((F.col(f"r_{r}") < TRUST * mean[r]).alias(f"trust_{r}"))
    return hosts.select("*", (~bad).alias("host_ok"), *trust)


def with_verdict(rows: DataFrame, hosts: DataFrame, host: str, bits: str) -> DataFrame:
    """Add _q_kept to rows: whether the document passes the base rules, its host's verdict, and each soft
    rule that its host isn't trusted with; who fails every soft rule is trusted with none.

    Up to BROADCAST_HOSTS hosts are broadcast. More are joined by a shuffle, in which each row
    goes to one of 64 salts of its host, so no host gathers in a task.
    """
    keyed = rows.withColumn("_q_null", F.col(host).isNull()).withColumn("_q_name", F.coalesce(F.col(host).cast("string"), F.lit("")))
    side, on = hosts.select(F.col("host_null").alias("_q_null"), F.col("host_name").alias("_q_name"), F.col("host_ok").alias("_q_ok"), *(F.col(f"trust_{r}").alias(f"_q_{r}") for r in SOFT)), ["_q_null", "_q_name"]
    if hosts.count() <= BROADCAST_HOSTS:
        side = F.broadcast(side)
    else:
        keyed = keyed.withColumn("_q_salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int"))
        side, on = side.withColumn("_q_salt", F.explode(F.sequence(F.lit(0), F.lit(63)))), [*on, "_q_salt"]
    failed = F.lit(True)
    for r in SOFT:
        failed = failed & fails(r, bits)
    for r in RULES:
        failed = failed | (fails(r, bits) & (~F.coalesce(f"_q_{r}", F.lit(False)) if r in SOFT else F.lit(True)))
    return keyed.join(side, on, "left").withColumn("_q_kept", ~failed & F.coalesce("_q_ok", F.lit(True))).drop(*on, "_q_ok", *(f"_q_{r}" for r in SOFT))


def score(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept of each row.

    Rows with equal or null ids are judged one by one; other columns are left out.
    """
    rows = materialize(docs.select("doc_id", F.col(host).alias("host"), let(measure(), lambda m: F.struct(m.alias("m"), failures(m).alias("fails"))).alias("q")).select("doc_id", "host", "q.m.*", "q.fails"), "quality-metrics")
    out = with_verdict(rows, host_verdicts(rows.select("host", "fails")), "host", "fails")
    return out.select("doc_id", "host", *METRICS[:5], (fails("short") | fails("repeats")).alias("base_failed"), F.col("_q_kept").alias("kept"))


def keep(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of docs that score() keeps, with exactly their own columns.

    Every text is measured once: the rows are written with their failures, from which the hosts
    are counted, and read again to be filtered.
    """
    rows = materialize(docs.withColumn("_q_fails", let(measure(), failures)), "quality-rows")
    hosts = host_verdicts(rows.select(F.col(host).alias("host"), F.col("_q_fails").alias("fails")))
    return with_verdict(rows, hosts, host, "_q_fails").filter("_q_kept").select(*docs.columns)
