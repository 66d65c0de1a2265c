"""Synonym rewriting over a thesaurus table (word, ord, syn, cnt)."""

from __future__ import annotations

import random
from _md5 import md5
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import script as S
from ..functions.batches import Cut, distinct_sorted, slices, transliterated

MODERN_COUNT = 3
#: Words with synonyms up to this number are sent to every executor (about 20 bytes each); more are joined by a shuffle of every word.
BROADCAST_WORDS = 2_000_000
#: Bytes of text whose words are looked up together, and choices of a word in one row of synonyms.
GROUP, BLOCK = 32 << 20, 64
#: Shares of a word's occurrences in a shuffled join.
SALTS = 16


def attested(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, ord, syn, cnt) from (word, syn): corpus counts, 0 where unseen; ord follows the synonyms' order."""
    cnt = counts.select(F.col("word").alias("syn"), "cnt")
    w = Window.partitionBy("word").orderBy("syn")
    return pairs.join(cnt, "syn", "left").select("word", F.row_number().over(w).alias("ord"), "syn", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def choices(thesaurus: DataFrame, modern_only: bool = False) -> DataFrame:
    """(word, choice, syn): synonyms numbered from 0 by falling count, then in their order."""
    kept = thesaurus.filter(F.col("cnt") >= MODERN_COUNT) if modern_only else thesaurus
    w = Window.partitionBy("word").orderBy(F.desc("cnt"), "ord", "syn")
    return kept.select("word", (F.row_number().over(w) - 1).alias("choice"), "syn")


def alternatives(thesaurus: DataFrame, modern_only: bool = False) -> DataFrame:
    """(word, choices): synonyms by falling count, then in their order."""
    kept = thesaurus.filter(F.col("cnt") >= MODERN_COUNT) if modern_only else thesaurus
    sort = F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("c"), "ord", "syn")))
    return kept.groupBy("word").agg(F.transform(sort, lambda x: x.syn).alias("choices"))


def _pieces(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """_row, keys, i, no, gap, run, key: each run of Thaana with the text before it, and a last row for what follows.

    no is the run's place among all runs, gaps counted. key is the word; a row without one has a key of its own
    that no word equals, so such rows don't meet in one task. These rows are shuffled, so none holds a string
    twice: run is null where there is a word, as only a run without one is written as it stands.
    """
    runs = F.concat(F.regexp_extract_all("t", F.lit(S.RUN), F.lit(0)), F.array(F.lit("")))
    first = F.when(F.col("t").rlike(f"^{S.RUN}"), 0).otherwise(1)
    # all that depends on the whole text is in the exploded array: a token row doesn't carry the text
    each = S.let(F.struct(first.alias("f"), F.split("t", S.RUN, -1).alias("g"), runs.alias("r")), lambda s: F.transform(s.r, lambda r, i: F.struct((2 * i + s.f).alias("no"), F.get(s.g, i).alias("gap"), r.alias("run"))))
    rows = df.withColumn("_row", F.monotonically_increasing_id()).select("_row", *keys, F.posexplode(each).alias("i", "x"))
    word = F.translate("x.run", S.ZERO_WIDTH, "")
    key = F.when(word == "", F.concat(F.lit("\x01"), F.col("_row").cast("string"))).otherwise(word)
    return rows.select("_row", *keys, "i", "x.no", "x.gap", F.when(word == "", F.col("x.run")).alias("run"), key.alias("key"))


def _plain(latin: bool) -> Column:
    t = F.coalesce("t", F.lit(""))
    return S.latin_to_thaana(t) if latin else t


def _numbers(thesaurus: DataFrame, modern_only: bool) -> DataFrame:
    """(key, n): the number of choices of each word."""
    kept = thesaurus.filter(F.col("cnt") >= MODERN_COUNT) if modern_only else thesaurus
    return kept.groupBy(F.col("word").alias("key")).agg(F.count(F.lit(1)).cast("int").alias("n"))


def _with_numbers(pieces: DataFrame, numbers: DataFrame) -> DataFrame:
    """pieces with n, the number of choices of their word; null without any."""
    salted = numbers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pieces.withColumn("salt", F.pmod("no", F.lit(SALTS))).join(salted, ["key", "salt"], "left").drop("salt")


def _assembled(pieces: DataFrame, named: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, text, replacements, swapped and swappable from pieces with n and choice (null: not swapped).

    Only the chosen synonym of each swapped word is joined, by word and number.
    """
    syns = named.select(F.col("word").alias("key"), "choice", F.col("syn").alias("used"))
    spread = pieces.withColumn("choice", F.coalesce("choice", (-1 - F.pmod(F.xxhash64("_row", "i"), F.lit(1 << 30))).cast("int")))
    out = spread.join(syns, ["key", "choice"], "left")
    row = F.struct("i", "gap", F.when(F.col("run").isNull(), F.col("key")).alias("word"), "run", "n", "used")
    texts = out.groupBy("_row", *keys).agg(F.array_sort(F.collect_list(row)).alias("p"))
    texts = texts.withColumn("p", F.transform("p", lambda x: F.struct(x.gap.alias("gap"), x.word.alias("word"), F.coalesce(x.used, x.run, x.word).alias("out"), x.n.alias("n"), x.used.alias("used"))))

    def spans(p: Column) -> Column:
        ends = S.running(F.transform(p, lambda x: F.length(x.gap) + F.length(x.out)))
        held = S.let(ends, lambda e: F.transform(p, lambda x, k: F.struct((F.get(e, k) - F.length(x.out)).alias("start"), F.get(e, k).alias("end"), x.word.alias("original"), x.n.alias("choices"), x.used.alias("used"))))
        return F.filter(held, lambda x: x.choices.isNotNull())

    done = texts.select(*keys, F.array_join(F.transform("p", lambda x: F.concat(x.gap, x.out)), "").alias("text"), S.let(F.col("p"), spans).alias("replacements"))
    return done.select("*", F.size(F.filter("replacements", lambda x: x.used.isNotNull())).cast("long").alias("swapped"), F.size("replacements").cast("long").alias("swappable"))


REPLACEMENTS = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer").add("original", "string").add("choices", "integer").add("used", "string"))
#: Draws of texts: from the prefixes, the places of swappable words, their numbers of choices and where each text's begin, a choice each or -1.
Draws = Callable[[list[str], np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _hash_draws(level: int) -> Draws:
    def draws(prefixes: list[str], no: np.ndarray, n: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        digests, places = [], [b"%d" % k for k in range(no.max(initial=-1) + 1)]
        for prefix, a, b in zip(prefixes, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            begin = f"{prefix}:".encode()
            digests += [md5(begin + places[k]).digest() for k in no[a:b].tolist()]
        # seven hexadecimal digits from the first on and from the ninth on
        two = np.frombuffer(b"".join(digests), ">u4").reshape(-1, 4)[:, :2].astype(np.int64) >> 4
        return np.where(two[:, 0] % 1_000_000 < level, two[:, 1] % np.maximum(n, 1), -1)

    return draws


def _python_draws(level: float, seed: int) -> Draws:
    def draws(prefixes: list[str], no: np.ndarray, n: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        out, begun = [], random.Random(seed).getstate()
        rng = random.Random()
        numbers = n.tolist()
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            rng.setstate(begun)
            out += [rng.choice(range(k)) if rng.random() < level else -1 for k in numbers[a:b]]
        return np.array(out, np.int64)

    return draws


def _looked_up(cut: Cut, words: pa.Array, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run's word by its number in words (-1: none), and its number of choices."""
    index = pc.fill_null(pc.index_in(cut.words(), value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    word = index[cut.codes[cut.run]]
    return word, np.where(word >= 0, np.append(numbers, 0)[word], 0)


def _rewritten(df: DataFrame, named: DataFrame, numbers: DataFrame, keys: tuple[str, ...], prefix: Column, draws: Draws, latin: bool, spans: bool) -> DataFrame:
    """keys, text, replacements (null unless spans), swapped and swappable; only texts and, once for each group of them, the words' chosen synonyms are shuffled.

    A group is some GROUP bytes of a task's texts. Its rows are the texts, packed with their draws,
    and the distinct words and choices asked for: a word's 64 choices from a multiple on are a row,
    and mask has a bit for each asked. The answers meet the group's texts.
    """
    table = numbers.toArrow()
    words, counts = table.column(0).combine_chunks(), table.column(1).to_numpy().astype(np.int64)
    known = df.sparkSession.sparkContext.broadcast((words, counts))
    asked_schema = T.StructType().add("_group", "long").add("key", "string").add("block", "integer").add("mask", "long").add("blob", "binary")
    ints = T.ArrayType(T.IntegerType())
    key_fields = [df.schema[k] for k in keys]
    packed = to_arrow_schema(T.StructType([*key_fields, *T.StructType().add("lead", "boolean").add("runs", ints).add("gaps", ints).add("segments", T.ArrayType(T.StringType())).add("choices", ints)]))
    result = T.StructType([*key_fields, *T.StructType().add("text", "string").add("replacements", REPLACEMENTS).add("swapped", "long").add("swappable", "long")])
    arrow_asked, arrow_result = to_arrow_schema(asked_schema), to_arrow_schema(result)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, numbers = known.value
        group, size, wanted = TaskContext.get().partitionId() << 32, 0, []

        def requests() -> Iterator[pa.RecordBatch]:
            every = distinct_sorted(np.concatenate(wanted)) if wanted else np.array([], np.int64)
            word, choice = every >> 32, every & 0xFFFFFFFF
            starts = np.flatnonzero(np.diff(every // BLOCK, prepend=-1))
            masks = np.add.reduceat(np.left_shift(np.uint64(1), (choice % BLOCK).astype(np.uint64)), starts) if len(starts) else np.array([], np.uint64)
            for at in range(0, len(starts), 50_000):
                some = starts[at : at + 50_000]
                columns = [np.full(len(some), group), words.take(pa.array(word[some])), choice[some] // BLOCK, masks[at : at + 50_000].view(np.int64), pa.nulls(len(some), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) if isinstance(c, np.ndarray) else c.cast(f.type) for c, f in zip(columns, arrow_asked, strict=True)], schema=arrow_asked)

        for batch in batches:
            texts = batch.column(len(keys)).fill_null("")
            for at, end in slices(texts):
                some = texts.slice(at, end - at)
                cut = Cut(transliterated(some) if latin else some)
                word, n = _looked_up(cut, words, numbers)
                can = np.flatnonzero(n)
                choice = np.full(len(n), -1, np.int64)
                choice[can] = draws(batch.column(len(keys) + 1).slice(at, end - at).to_pylist(), cut.no[can], n[can], np.searchsorted(can, cut.first_run))
                done = choice >= 0
                wanted.append(distinct_sorted(word[done] << 32 | choice[done]))
                c = pa.ListArray.from_arrays(pa.array(cut.first_run, pa.int32()), pa.array(choice, pa.int32()))
                held = pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, end - at) for k in range(len(keys))), *cut.packed(), c], schema=packed)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, packed, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(held)
                yield pa.RecordBatch.from_arrays([pa.array([group]), pa.nulls(1, pa.string()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=arrow_asked)
                del cut, word, n, can, choice, done, c, held, sink
                pa.default_memory_pool().release_unused()
                size += pc.sum(pc.binary_length(some)).as_py() or 0
                if size >= GROUP:
                    yield from requests()
                    group, size, wanted = group + 1, 0, []
        yield from requests()

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(batch.column(1).is_valid()).select([0, 1, 2, 3])

    def write(texts: pa.Table, answers: pa.Table) -> pa.Table:
        words, numbers = known.value
        answers = answers.combine_chunks()
        found, syns = np.array([], np.int64), pa.array([], pa.string())
        if len(answers):
            answers = answers.to_batches()[0]
            word = pc.index_in(answers.column("key"), value_set=words).to_numpy(zero_copy_only=False).astype(np.int64)
            masks = answers.column("mask").to_numpy().astype("<i8")
            bits = np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, bit = np.nonzero(bits)
            found = word[row] << 32 | answers.column("block").to_numpy().astype(np.int64)[row] * BLOCK + bit
            joined = pa.concat_arrays([answers.column("syns")])
            ends = np.cumsum(np.concatenate([[0], answers.column("sizes").flatten().to_numpy()])).astype(np.int32)
            syns = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), joined.buffers()[2].slice(int(np.frombuffer(joined.buffers()[1], np.int32)[joined.offset])))
            order = np.argsort(found, kind="stable")
            found, syns = found[order], syns.take(pa.array(order))
        out = []
        for blob in texts.column("blob"):
            if not blob.is_valid:
                continue
            held = pa.ipc.open_stream(blob.as_buffer()).read_next_batch()
            cut = Cut.unpacked(*held.columns[len(keys) : -1])
            word, n = _looked_up(cut, words, numbers)
            choice = held.column(held.num_columns - 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            done, can = choice >= 0, np.flatnonzero(n)
            used = np.full(len(n), -1, np.int64)
            used[done] = np.searchsorted(found, word[done] << 32 | choice[done])
            text, *places = cut.rewritten(used, syns, spans)
            bounds = np.searchsorted(can, cut.first_run)
            if spans:
                start, end, written = places
                original = cut.words().take(pa.array(cut.codes[cut.run][can]))
                new = pc.if_else(pa.array(done[can]), written.take(pa.array(can)), pa.scalar(None, pa.string()))
                each = pa.StructArray.from_arrays([pa.array(start[can], pa.int32()), pa.array(end[can], pa.int32()), original, pa.array(n[can], pa.int32()), new], names=["start", "end", "original", "choices", "used"])
                replacements = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), each).cast(arrow_result.field("replacements").type)
            else:
                replacements = pa.nulls(len(held), arrow_result.field("replacements").type)
            swapped = np.diff(np.concatenate([[0], np.cumsum(done)])[cut.first_run])
            del cut, places, used
            pa.default_memory_pool().release_unused()
            out.append(pa.RecordBatch.from_arrays([*held.columns[: len(keys)], text, replacements, pa.array(swapped, pa.int64()), pa.array(np.diff(bounds), pa.int64())], schema=arrow_result))
        return pa.Table.from_batches(out, schema=arrow_result)

    dealt = df.select(*keys, "t", prefix.alias("_prefix")).mapInArrow(ask, asked_schema).repartition("_group")
    # through Python, so that no filter moves below the exchange, which then is shared
    asked = dealt.mapInArrow(asks, T.StructType(asked_schema.fields[:4]))
    lists = named.groupBy(F.col("word").alias("key"), F.floor(F.col("choice") / BLOCK).cast("int").alias("block"))
    lists = lists.agg(F.transform(F.array_sort(F.collect_list(F.struct("choice", "syn"))), lambda x: x.syn).alias("all"))
    chosen = F.filter("all", lambda s, i: F.call_function("getbit", F.col("mask"), i) == 1)
    answers = asked.join(lists, ["key", "block"]).select("_group", "key", "block", "mask", chosen.alias("chosen"))
    # in one string, and their bytes: an array's rows take twice the disk
    answers = answers.select("_group", "key", "block", "mask", F.array_join("chosen", "").alias("syns"), F.transform("chosen", lambda s: F.octet_length(s)).alias("sizes"))
    return dealt.groupBy("_group").cogroup(answers.groupBy("_group")).applyInArrow(write, result)


def paraphrase(df: DataFrame, thesaurus: DataFrame, *keys: str, aggressiveness: float = 0.5, seed: int = 0, modern_only: bool = False, latin: bool = False, spans: bool = True) -> DataFrame:
    """keys, text, replacements, swapped and swappable; draws come from a hash of seed, keys and place, so any engine and partitioning agrees.

    A swappable word is replaced if its draw is below the aggressiveness (held to 0 to 1); a second
    draw picks the choice. replacements holds, per swappable word, its place in the new text, the
    number of its choices and the one used, if any; choices() has them by number; without spans it
    is null. Texts without words, empty ones among them, stay as they are; a null text is an empty
    one. With latin, t is transliterated first.
    """
    level = round(min(max(aggressiveness, 0.0), 1.0) * 1_000_000)
    named = choices(thesaurus, modern_only)
    begin = F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in keys))
    if (numbers := _numbers(thesaurus, modern_only)).count() <= BROADCAST_WORDS:
        return _rewritten(df, named, numbers, keys, begin, _hash_draws(level), latin, spans)
    df = df.withColumn("t", _plain(latin))
    pieces = _with_numbers(_pieces(df, keys), numbers)
    h = F.md5(F.concat_ws(":", begin, F.col("no").cast("string")))
    draw = lambda at: F.conv(F.substring(h, at, 7), 16, 10).cast("long")
    swap = F.col("n").isNotNull() & (F.pmod(draw(1), F.lit(1_000_000)) < level)
    return _assembled(pieces.withColumn("choice", F.when(swap, F.pmod(draw(9), F.col("n")).cast("int"))), named, keys)


def paraphrase_exact(df: DataFrame, thesaurus: DataFrame, *keys: str, aggressiveness: float = 0.5, seed: int = 0, modern_only: bool = False, latin: bool = False, spans: bool = True) -> DataFrame:
    """As paraphrase(), with Python's generator seeded per text: a draw per swappable word in order, then a choice."""
    level = min(max(aggressiveness, 0.0), 1.0)
    named = choices(thesaurus, modern_only)
    if (numbers := _numbers(thesaurus, modern_only)).count() <= BROADCAST_WORDS:
        return _rewritten(df, named, numbers, keys, F.lit(""), _python_draws(level, seed), latin, spans)
    df = df.withColumn("t", _plain(latin))
    pieces = _with_numbers(_pieces(df, keys), numbers)
    texts = pieces.groupBy("_row", *keys).agg(F.array_sort(F.collect_list(F.struct("i", "gap", "run", "key", "n"))).alias("p"))

    @F.pandas_udf("array<int>")
    def draws(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for numbers in texts:
                rng, row = random.Random(seed), []
                for n in numbers:
                    row.append(rng.choice(range(n)) if n and rng.random() < level else None)
                out.append(row)
            yield pd.Series(out, dtype="object")

    drawn = texts.withColumn("c", draws(F.transform("p", lambda x: F.coalesce(x.n, F.lit(0)))))
    rows = drawn.select("_row", *keys, F.explode(F.arrays_zip("p", F.col("c"))).alias("x")).select("_row", *keys, "x.p.*", F.col("x.c").alias("choice"))
    return _assembled(rows, named, keys)
