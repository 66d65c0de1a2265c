"""Grammar rules as issue tables, the register of sentences, and their conversion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import script as S

# The particle, the marks, and the formal endings with their informal forms, in order.
EVE, EVE_ENDING = "އެވެ", "ެވެ"
MARKS = [(",", "،", "thaana-comma"), ("?", "؟", "thaana-question"), (";", "؛", "thaana-semicolon")]
PUNCTUATION = ".،؛؟!"
INFORMAL = [("ީމެވެ", "ީ"), ("ަމެވެ", "ަން"), ("ގައެވެ", "ގައި"), ("އެވެ", ""), ("ެވެ", S.SUKUN)]
LONG_SENTENCE, SUBSTANTIAL, FORMAL_SHARE = 40, 3, 0.6
SEVERITY = {"thaana-comma": "error", "thaana-question": "error", "thaana-semicolon": "error", "space-before-punct": "error", "space-after-punct": "warning", "double-space": "style", "repeated-word": "warning", "detached-eve": "error", "long-sentence": "style", "formal-register": "style"}
#: What a finding says, by rule.
MESSAGE = {
    "thaana-comma": "Latin comma in Thaana text", "thaana-question": "Latin question mark in Thaana text", "thaana-semicolon": "Latin semicolon in Thaana text", "space-before-punct": "space before a punctuation mark",
    "space-after-punct": "no space after a punctuation mark", "double-space": "more than one space", "repeated-word": "the same word twice", "detached-eve": "the sentence ending belongs to the word before it",
    "long-sentence": f"sentence of more than {LONG_SENTENCE} words", "formal-register": "informal sentence in a formal text",
}
SENTENCE = r"[^.!؟\n]+[.!؟]?"


def merge_eve(word: Column) -> Column:
    short = F.concat(F.substring(word, F.lit(1), F.length(word) - 1), F.lit(EVE_ENDING))
    return F.when(word.endswith(S.SUKUN) | word.endswith("އި"), short).otherwise(F.concat(word, F.lit(EVE)))


#: What a rule gives for a text: array of struct(rule, start, end, replacement), in the text's own row.
Rule = Callable[[Column], Column]


def _issue(rule: Column | str, start: Column, end: Column, replacement: Column) -> Column:
    rule = F.lit(rule) if isinstance(rule, str) else rule
    return F.struct(rule.alias("rule"), start.alias("start"), end.alias("end"), replacement.alias("replacement"))


_TYPE = "array<struct<rule:string,start:int,end:int,replacement:string>>"


def _only(text: Column, pattern: str, issues: Column) -> Column:
    """issues, worked out only for texts that hold the pattern at all."""
    return F.when(text.rlike(pattern), issues.cast(_TYPE)).otherwise(F.array().cast(_TYPE))


def punctuation(t: Column) -> Column:
    """Latin marks after a Thaana letter; the span takes in the spaces between."""
    pattern = f"[{S.THAANA}] *[,?;]"

    def of(x: Column) -> Column:
        mark = F.right(x.m, F.lit(1))
        rule = F.when(mark == ",", MARKS[0][2]).when(mark == "?", MARKS[1][2]).otherwise(MARKS[2][2])
        return _issue(rule, x.start + 1, x.end, F.translate(mark, ",?;", "،؟؛"))

    return _only(t, pattern, F.transform(S.found(t, pattern), of))


def space_before(t: Column) -> Column:
    # runs of spaces are matched whole, with or without a mark, so that a long run is read once
    runs = F.filter(S.found(t, f" +[{PUNCTUATION}]?"), lambda x: x.m.rlike(f"[{PUNCTUATION}]$"))
    return _only(t, f" [{PUNCTUATION}]", F.transform(runs, lambda x: _issue("space-before-punct", x.start, x.end, F.right(x.m, F.lit(1)))))


def space_after(t: Column) -> Column:
    pattern = f"[{PUNCTUATION}][{S.THAANA}]"
    return _only(t, pattern, F.transform(S.found(t, pattern), lambda x: _issue("space-after-punct", x.start, x.start + 1, F.concat(F.left(x.m, F.lit(1)), F.lit(" ")))))


def double_space(t: Column) -> Column:
    return _only(t, "  ", F.transform(S.found(t, "  +"), lambda x: _issue("double-space", x.start, x.end, F.lit(" "))))


def _pairs(t: Column, fits: Callable[[Column, Column], Column], rule: str, put: Callable[[Column], Column]) -> Column:
    """Issues for neighbouring words (p, w) that fit, with nothing but white space between them."""

    def of(words: Column) -> Column:
        both = F.transform(words, lambda x, i: F.struct(F.get(words, i - 1).alias("p"), x.alias("w")))
        gap = lambda b: F.substring(t, b.p.end + 1, b.w.start - b.p.end)
        held = F.filter(F.filter(both, lambda b: b.p.isNotNull() & fits(b.p.word, b.w.word)), lambda b: gap(b).rlike(f"^[{S.WIDE_SPACE}]*$"))
        return F.transform(held, lambda b: _issue(rule, b.p.start, b.w.end, put(b.p.word)))

    return S.let(S.located_words(t), of).cast(_TYPE)


def repeated_words(t: Column) -> Column:
    return _pairs(t, lambda p, w: p == w, "repeated-word", lambda p: p)


def detached_eve(t: Column) -> Column:
    issues = _pairs(t, lambda p, w: (w == EVE) & (p != EVE), "detached-eve", merge_eve)
    return F.when(F.translate(t, S.ZERO_WIDTH, "").contains(EVE), issues).otherwise(F.array().cast(_TYPE))


def sentences(t: Column) -> Column:
    """array of struct(n words, first_start, last, last_start, last_end, formal) of the sentences that have words."""

    def of(s: Column) -> Column:
        def put(w: Column) -> Column:
            last = F.try_element_at(w, F.lit(-1))
            return F.struct(F.size(w).alias("n"), (s.start + F.get(w, 0).start).alias("first_start"), last.word.alias("last"), (s.start + last.start).alias("last_start"), (s.start + last.end).alias("last_end"), last.word.endswith(EVE_ENDING).alias("formal"))

        return S.let(S.located_words(s.m), put)

    return F.filter(F.transform(S.found(t, SENTENCE), of), lambda s: s.n > 0)


def long_sentences(t: Column) -> Column:
    found = F.filter(sentences(t), lambda s: s.n > LONG_SENTENCE)
    return F.transform(found, lambda s: _issue("long-sentence", s.first_start, s.last_end, F.lit(None).cast("string"))).cast(_TYPE)


def formal_register(t: Column) -> Column:
    """Informal sentences of three words or more in texts of at least three such, six tenths of which are formal."""

    def of(s: Column) -> Column:
        formal = F.size(F.filter(s, lambda x: x.formal))
        found = F.when((F.size(s) >= 3) & (formal / F.size(s) >= FORMAL_SHARE), F.filter(s, lambda x: ~x.formal)).otherwise(F.slice(s, 1, 0))
        return F.transform(found, lambda x: _issue("formal-register", x.last_start, x.last_end, F.lit(None).cast("string")))

    issues = S.let(F.filter(sentences(t), lambda s: s.n >= SUBSTANTIAL), of).cast(_TYPE)
    return F.when(F.translate(t, S.ZERO_WIDTH, "").contains(EVE_ENDING), issues).otherwise(F.array().cast(_TYPE))


RULES: dict[str, Rule] = {"punctuation": punctuation, "space_before": space_before, "space_after": space_after, "double_space": double_space, "repeated_words": repeated_words, "detached_eve": detached_eve, "long_sentences": long_sentences, "formal_register": formal_register}


#: Rules whose issues have no replacement.
UNFIXABLE = ("long_sentences", "formal_register")


def issues(df: DataFrame, rule: Rule, *keys: str) -> DataFrame:
    """keys, rule, start, end and replacement of one rule's issues."""
    return df.select(*keys, F.explode(rule(F.col("t"))).alias("x")).select(*keys, "x.*")


def check(df: DataFrame, *keys: str) -> DataFrame:
    """keys, no, rule, severity, message, start, end and replacement of all issues, numbered per text by start, end and rule order.

    A text is checked within its own row: nothing is shuffled, and texts with equal keys stay apart.
    """
    t = F.col("t")
    parts = [F.transform(rule(t), lambda x, k=k: F.struct(x.start.alias("start"), x.end.alias("end"), F.lit(k).alias("ord"), x.rule.alias("rule"), x.replacement.alias("replacement"))) for k, rule in enumerate(RULES.values())]
    fixed = lambda named: F.create_map(*(F.lit(x) for kv in named.items() for x in kv))[F.col("x.rule")]
    rows = df.select(*keys, F.posexplode(F.array_sort(F.concat(*parts))).alias("no", "x"))
    return rows.select(*keys, (F.col("no") + 1).alias("no"), "x.rule", fixed(SEVERITY).alias("severity"), fixed(MESSAGE).alias("message"), "x.start", "x.end", "x.replacement")


def fixed(t: Column, rules: tuple[str, ...] = tuple(RULES)) -> Column:
    """A text with the replacements of the rules' issues put in.

    Of overlapping ones the first stays, of those that start together the longest; the others are
    left for another pass.
    """
    every = F.filter(F.concat(*(RULES[r](t) for r in rules if r not in UNFIXABLE)), lambda x: x.replacement.isNotNull())
    ordered = F.array_sort(F.transform(every, lambda x: F.struct(x.start.alias("start"), (-x.end).alias("back"), x.replacement.alias("new"))))

    def keep(acc: Column, x: Column) -> Column:
        piece = F.struct(acc.at.alias("begin"), x.start.alias("end"), x.new.alias("new"))
        return F.when(x.start >= acc.at, F.struct((-x.back).alias("at"), F.concat(acc.out, F.array(piece)).alias("out"))).otherwise(acc)

    none = F.array().cast("array<struct<begin:int,end:int,new:string>>")
    # issues are taken in blocks, so that an array that grows by one at a time stays short
    def block(acc: Column, some: Column) -> Column:
        done = F.aggregate(some, F.struct(acc.at.alias("at"), none.alias("out")), keep)
        return S.let(done, lambda d: F.struct(d.at.alias("at"), F.concat(acc.out, F.array(d.out)).alias("out")))

    def put(i: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.floor((F.size(i) + 31) / 32).cast("int"))
        blocks = F.transform(cuts, lambda k: F.slice(i, k * 32 + 1, 32))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<begin:int,end:int,new:string>>>").alias("out"))
        return S.let(F.aggregate(blocks, begin, block), rewrite)

    def rewrite(kept: Column) -> Column:
        def of(part: Column) -> Column:
            pieces = F.transform(F.flatten(kept.out), lambda x: F.concat(S.between(part, x.begin, x.end), x.new))
            return F.concat(F.array_join(pieces, ""), S.between(part, kept.at, F.length(t)))

        return S.let(S.blocks(t), of)

    return S.let(ordered, lambda i: F.when(F.size(i) == 0, t).otherwise(put(i)))


def to_informal_word(word: Column) -> Column:
    out = word
    for ending, new in reversed(INFORMAL):
        out = F.when(word.endswith(ending) & (F.length(word) > len(ending) + 1), F.concat(F.substring(word, F.lit(1), F.length(word) - len(ending)), F.lit(new))).otherwise(out)
    return out


def to_formal_word(word: Column) -> Column:
    return F.when(word.endswith(EVE_ENDING), word).otherwise(merge_eve(word))


def convert(text: Column, fn) -> Column:
    """Rewrite the last word of every sentence; the text between stays."""

    def of(sentence: Column) -> Column:
        def put(parts: Column) -> Column:
            # the place of the last run that holds a letter, counted from the end
            back = F.array_position(F.transform(F.reverse(parts), lambda x: x.rlike(f"[{S.THAANA}]")), True).cast("int")
            at = F.size(parts) - back + 1

            def rewrite(w: Column) -> Column:
                new = F.concat(F.array_join(F.slice(parts, 1, at - 1), ""), fn(w), F.array_join(F.slice(parts, at + 1, F.size(parts)), ""))
                return F.when(fn(w) == w, sentence).otherwise(new)

            return F.when(back == 0, sentence).otherwise(S.let(F.translate(F.try_element_at(parts, at), S.ZERO_WIDTH, ""), rewrite))

        return S.let(S.segments(sentence), put)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("[^.!؟\n]+[.!؟]?\n?|[.!؟\n]"), F.lit(0)), of), "")
