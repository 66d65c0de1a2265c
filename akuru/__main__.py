"""Command line: check, suggest, validate, grammar, paraphrase, define, reverse, to-thaana, to-latin, formal, informal.

    python -m akuru check --lexicon words.tsv [--bigrams pairs.tsv] [--json] TEXT | --file PATH | -
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import script as S
from .operators import corpus, dictionary, grammar, paraphrase, spelling
from .sources import tables

CONVERSIONS = {
    "to-thaana": S.latin_to_thaana,
    "to-latin": S.thaana_to_latin,
    "formal": lambda t: grammar.convert(t, grammar.to_formal_word),
    "informal": lambda t: grammar.convert(t, grammar.to_informal_word),
}


def run(spark: SparkSession, options: argparse.Namespace, text: str) -> tuple[DataFrame, bool]:
    """The command's rows, and whether any of them are faults."""
    df = spark.createDataFrame([(0, text)], "k int, t string")
    command = options.command
    if command in CONVERSIONS:
        return df.select(CONVERSIONS[command](F.col("t")).alias("text")), False
    if command == "validate":
        words = corpus.tokens(df, "k")
        return words.select("word", S.units(F.col("word")).alias("units"), S.explained(S.structure_errors(F.col("word"))).alias("errors")), False
    if command == "grammar":
        return grammar.check(df, "k").drop("k").orderBy("no"), True
    if command == "paraphrase":
        return paraphrase.paraphrase_exact(df, tables.thesaurus(spark, options.thesaurus), "k", aggressiveness=options.aggressiveness, seed=options.seed, modern_only=options.modern).drop("k"), False
    if command in ("define", "reverse"):
        known = tables.definitions(spark, options.definitions)
        return (dictionary.define(known, text.strip()) if command == "define" else dictionary.reverse_lookup(known, text)), False
    lexicon = tables.word_list(spark, *options.lexicon)
    if command == "suggest":
        return spelling.check_words(corpus.tokens(df, "k").select("word"), lexicon, options.limit).select("word", "status", "via", "suggestions").orderBy("word"), False
    pairs = tables.counts(spark, options.bigrams, pairs=True, last_wins=True) if options.bigrams else spark.createDataFrame([], "w1 string, w2 string, cnt long")
    return spelling.check_text(corpus.tokens(df, "k", neighbours=True), lexicon, pairs, "k").drop("k", "pos").orderBy("start"), True


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="akuru", description=__doc__.splitlines()[0])
    parser.add_argument("command", choices=["check", "suggest", "validate", "grammar", "paraphrase", "define", "reverse", *CONVERSIONS])
    parser.add_argument("text", nargs="?", default="-")
    parser.add_argument("--file")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--lexicon", action="append", default=[])
    parser.add_argument("--bigrams")
    parser.add_argument("--thesaurus")
    parser.add_argument("--definitions")
    parser.add_argument("--limit", type=int, default=5)
    parser.add_argument("--seed", type=int, default=0)
    parser.add_argument("--aggressiveness", type=float, default=0.5)
    parser.add_argument("--modern", action="store_true")
    options = parser.parse_intermixed_args(args)
    text = open(options.file, encoding="utf-8").read() if options.file else sys.stdin.read() if options.text == "-" else options.text
    spark = SparkSession.builder.getOrCreate()
    rows, faults = run(spark, options, text)
    found = rows.toJSON().collect()
    if options.json:
        print(json.dumps([json.loads(x) for x in found], ensure_ascii=False, indent=1))
    else:
        for x in map(json.loads, found):
            print("\t".join(str(v) if not isinstance(v, list) else json.dumps(v, ensure_ascii=False) for v in x.values()))
    return int(faults and bool(found))


if __name__ == "__main__":
    sys.exit(main())
