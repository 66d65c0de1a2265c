"""Thaana script as column expressions: character classes, tokens, units, validation, transliteration.

Each expression has a DuckDB twin (``*_sql``), used to verify the queries independently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The script's code points, the sets the checks depend on, and the letter maps.
CONSONANT = "ހ-ޥޱ"
FILI = "ަ-ް"
THAANA = "ހ-ޱ"
ZERO_WIDTH = "\u200C\u200D"
SUKUN, NOONU, ALIFU = "ް", "ނ", "އ"
PRENASAL_FOLLOWERS = "ބޑދގ"
LENGTH_PAIRS = [("ަ", "ާ"), ("ި", "ީ"), ("ު", "ޫ"), ("ެ", "ޭ"), ("ޮ", "ޯ")]
CONFUSION_SETS = ["ހޙޚ", "ސޘޞ", "ށޝ", "ޒޛޟޡޜ", "ތޠ", "އޢ", "ގޣ", "ކޤ", "ވޥ", "ނޏޱ"]
TO_LATIN = {
    "ހ": "h", "ށ": "sh", "ނ": "n", "ރ": "r", "ބ": "b", "ޅ": "lh", "ކ": "k", "އ": "", "ވ": "v", "މ": "m", "ފ": "f", "ދ": "dh", "ތ": "th", "ލ": "l", "ގ": "g",
    "ޏ": "gn", "ސ": "s", "ޑ": "d", "ޒ": "z", "ޓ": "t", "ޔ": "y", "ޕ": "p", "ޖ": "j", "ޗ": "ch", "ޘ": "th", "ޙ": "h", "ޚ": "kh", "ޛ": "z", "ޜ": "zh", "ޝ": "sh",
    "ޞ": "s", "ޟ": "z", "ޠ": "t", "ޡ": "z", "ޢ": "a", "ޣ": "gh", "ޤ": "q", "ޥ": "w", "ޱ": "n",
    "ަ": "a", "ާ": "aa", "ި": "i", "ީ": "ee", "ު": "u", "ޫ": "oo", "ެ": "e", "ޭ": "ey", "ޮ": "o", "ޯ": "oa", "ް": "",
}
DIGRAPHS = {"lh": "ޅ", "sh": "ށ", "th": "ތ", "dh": "ދ", "gn": "ޏ", "ch": "ޗ", "kh": "ޚ", "gh": "ޣ", "zh": "ޜ"}
SINGLES = {"h": "ހ", "n": "ނ", "r": "ރ", "b": "ބ", "k": "ކ", "v": "ވ", "m": "މ", "f": "ފ", "l": "ލ", "g": "ގ", "s": "ސ", "d": "ޑ", "z": "ޒ", "t": "ޓ", "y": "ޔ", "p": "ޕ", "j": "ޖ", "w": "ޥ", "q": "ޤ"}
VOWELS = {"aa": "ާ", "ee": "ީ", "oo": "ޫ", "ey": "ޭ", "oa": "ޯ", "ai": "ައި", "a": "ަ", "i": "ި", "u": "ު", "e": "ެ", "o": "ޮ"}

#: White space in the wide sense, as a class body for both engines' regular expressions.
WIDE_SPACE = "\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


# --- transliteration: a chain of replacements, rendered for either engine -----------------
#
# Letters that await their neighbour are held as private-use code points: consonants from
# U+E000, vowels from U+E040. U+E080 after a consonant says that it has no vowel yet.

_C = {c: chr(0xE000 + k) for k, c in enumerate(dict.fromkeys([*DIGRAPHS.values(), *SINGLES.values()]))}
_V = {v: chr(0xE040 + k) for k, v in enumerate(VOWELS)}
_WORKING = "\uE000-\uE0FF"
_OPEN, _KS, _BARE, _L, _R = "\uE080", "\uE0F0", "\uE0F1", "\uE0F2", "\uE0F3"


def _translit_steps() -> list[tuple[str, str, str]]:
    upper = "ABDEFGHIJKLMNOPQRSTUVWXYZ"  # a C outside ch is copied as it is
    steps = [("chars", upper, upper.lower())]
    steps += [("regex", "[cC]h", _C["ޗ"])] + [("text", d, _C[c]) for d, c in DIGRAPHS.items() if d != "ch"]
    steps += [("text", "n'", _BARE), ("regex", "(aa|ee|oo|ey|oa|ai)", f"{_L}\\1{_R}")]
    steps += [("text", _L + v + _R, _V[v]) for v in VOWELS if len(v) == 2]
    steps += [("chars", "".join(v for v in VOWELS if len(v) == 1), "".join(_V[v] for v in VOWELS if len(v) == 1))]
    # a final h sounds as shaviyani
    steps += [("text", "x", _KS + _C["ސ"]), ("regex", "h([^\\p{L}\uE000-\uE0FF]|\\z)", _C["ށ"] + "\\1")]
    steps += [("chars", "".join(SINGLES), "".join(_C[c] for c in SINGLES.values()))]
    steps += [("regex", "([\uE000-\uE03F])", f"\\1{_OPEN}")]
    steps += [("text", _OPEN + _V[v], f) for v, f in VOWELS.items()] + [("text", _V[v], ALIFU + f) for v, f in VOWELS.items()]
    steps += [("text", _OPEN, SUKUN), ("text", _KS, "ކް"), ("chars", "".join(_C.values()) + _BARE, "".join(_C) + NOONU)]
    return steps


def latin_to_thaana(text: Column) -> Column:
    """Latin letters to Thaana; a consonant without a vowel gets sukun, a vowel without a consonant rides on alifu.

    Anything else is copied. The chain's working symbols are copied too: a text that holds them
    is cut at them, which changes no letter, as they end a syllable like any other mark.
    """
    runs = F.regexp_extract_all(text, F.lit(f"[{_WORKING}]+|[^{_WORKING}]+"), F.lit(0))
    apart = F.array_join(F.transform(runs, lambda r: F.when(r.rlike(f"^[{_WORKING}]"), r).otherwise(_chain(r))), "")
    return F.when(text.rlike(f"[{_WORKING}]"), apart).otherwise(_chain(text))


def _chain(text: Column) -> Column:
    for kind, a, b in _translit_steps():
        text = F.translate(text, a, b) if kind == "chars" else F.replace(text, F.lit(a), F.lit(b)) if kind == "text" else F.regexp_replace(text, a, b.replace("\\1", "$1"))
    return text


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def latin_to_thaana_sql(text: str) -> str:
    for kind, a, b in _translit_steps():
        f, more = {"chars": ("translate", ""), "text": ("replace", ""), "regex": ("regexp_replace", ", 'g'")}[kind]
        text = f"{f}({text}, {quoted(a)}, {quoted(b)}{more})"
    return text


def thaana_to_latin(text: Column) -> Column:
    """Every mapped character by its Latin form; others stay."""
    for a, b in TO_LATIN.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def thaana_to_latin_sql(text: str) -> str:
    for a, b in TO_LATIN.items():
        text = f"replace({text}, {quoted(a)}, {quoted(b)})"
    return text


# --- tokens -------------------------------------------------------------------------------


def running(lengths: Column, block: int = 32) -> Column:
    """Running sums of an array of ints. They are built in blocks, so that the work grows with the array's size."""
    nothing = F.array().cast("array<int>")
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0))
    sums = lambda a: F.aggregate(a, nothing, lambda acc, v: F.concat(acc, F.array(last(acc) + v)))

    def join(parts: Column) -> Column:
        bases = sums(F.transform(parts, last))
        return let(bases, lambda b: F.flatten(F.transform(parts, lambda x, k: F.transform(x, lambda v: v + F.coalesce(F.get(b, k - 1), F.lit(0))))))

    def of(a: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.floor((F.size(a) + (block - 1)) / block).cast("int"))
        return let(F.transform(cuts, lambda k: sums(F.slice(a, k * block + 1, block))), join)

    return let(lengths, of)


def found(text: Column, pattern: str) -> Column:
    """array of struct(m, start, end): a pattern's matches with their offsets in code points, worked out within the row."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap"))

    def of(b: Column) -> Column:
        ends = running(F.transform(b.m, lambda m, i: F.length(m) + F.length(F.get(b.gap, i))))
        return let(ends, lambda e: F.transform(b.m, lambda m, i: F.struct(m.alias("m"), (F.get(e, i) - F.length(m)).alias("start"), F.get(e, i).alias("end"))))

    return let(both, of)


_BLOCK = 1024


def blocks(text: Column) -> Column:
    """The text in blocks of equal numbers of code points, for between()."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))


def between(parts: Column, begin: Column, end: Column) -> Column:
    """Of a text in blocks(), code points begin to end; only the blocks they are in are read, as a substring counts from its text's first character."""
    first = F.floor(begin / _BLOCK).cast("int")
    last = F.floor(end / _BLOCK).cast("int")
    return F.substring(F.array_join(F.slice(parts, first + 1, last - first + 1), ""), begin - first * _BLOCK + 1, end - begin)


RUN = f"[{THAANA}{ZERO_WIDTH}]+"


def located_words(text: Column) -> Column:
    """array of struct(word, start, end): words() with their offsets, which count zero-width joiners."""
    of = F.transform(found(text, RUN), lambda x: F.struct(F.translate(x.m, ZERO_WIDTH, "").alias("word"), x.start.alias("start"), x.end.alias("end")))
    return F.filter(of, lambda x: x.word != "")


def segments(text: Column) -> Column:
    """The text cut into runs of Thaana (with zero-width joiners) and runs of anything else."""
    return F.regexp_extract_all(text, F.lit(f"[{THAANA}{ZERO_WIDTH}]+|[^{THAANA}{ZERO_WIDTH}]+"), F.lit(0))


def words(text: Column) -> Column:
    """The text's Thaana words in order, zero-width joiners removed, runs of nothing else dropped."""
    runs = F.regexp_extract_all(text, F.lit(f"[{THAANA}{ZERO_WIDTH}]+"), F.lit(0))
    return F.filter(F.transform(runs, lambda w: F.translate(w, ZERO_WIDTH, "")), lambda w: w != "")


def words_sql(text: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({text}, '[{THAANA}{ZERO_WIDTH}]+'), lambda w: translate(w, '{ZERO_WIDTH}', '')), lambda w: w <> '')"


# --- units and structure ------------------------------------------------------------------

_UNIT = f"[{CONSONANT}][{FILI}]?|[{FILI}]|(?s:.)"


def chunks(word: Column) -> Column:
    return F.regexp_extract_all(word, F.lit(_UNIT), F.lit(0))


def chunks_sql(word: str) -> str:
    return f"regexp_extract_all({word}, '{_UNIT}')"


def units(word: Column) -> Column:
    """array of struct(c, f): consonant and vowel sign, either of them null where missing; other characters give none."""
    unit = lambda x: F.struct(F.nullif(F.regexp_extract(x, f"^[{CONSONANT}]", 0), F.lit("")).alias("c"), F.nullif(F.regexp_extract(x, f"[{FILI}]$", 0), F.lit("")).alias("f"))
    return F.transform(F.filter(chunks(word), lambda x: x.rlike(f"^[{CONSONANT}{FILI}]")), unit)


def unit_keys(word: Column) -> Column:
    """array of two-character unit keys; a missing part is - or _."""
    key = lambda x: F.when(x.rlike(f"^[{FILI}]"), F.concat(F.lit("-"), x)).when(F.length(x) == 1, F.concat(x, F.lit("_"))).otherwise(x)
    return F.transform(F.filter(chunks(word), lambda x: x.rlike(f"^[{CONSONANT}{FILI}]")), key)


def unit_keys_sql(word: str) -> str:
    return (
        f"list_transform(list_filter({chunks_sql(word)}, lambda x: regexp_matches(x, '^[{CONSONANT}{FILI}]')), "
        f"lambda x: CASE WHEN regexp_matches(x, '^[{FILI}]') THEN '-' || x WHEN length(x) = 1 THEN x || '_' ELSE x END)"
    )


def structure_errors(word: Column) -> Column:
    """array of struct(index, code): missing-fili, orphan-fili and non-thaana, by code point index."""

    def of(parts: Column) -> Column:
        at = lambda i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda a, x: a + F.length(x))
        prenasal = lambda x, i: (x == NOONU) & F.coalesce(F.get(parts, i + 1).rlike(f"^[{PRENASAL_FOLLOWERS}]"), F.lit(False))
        code = lambda x, i: F.when(x.rlike(f"^[{FILI}]$"), "orphan-fili").when(x.rlike(f"^[^{CONSONANT}{FILI}]"), "non-thaana").when((F.length(x) == 1) & ~prenasal(x, i), "missing-fili")
        return F.filter(F.transform(parts, lambda x, i: F.struct(at(i).alias("index"), code(x, i).alias("code"))), lambda e: e.code.isNotNull())

    return let(chunks(word), of)


def structure_errors_sql(word: str) -> str:
    """list of struct(index, code)."""
    c = chunks_sql(word)
    code = (
        f"CASE WHEN regexp_matches(c[i], '^[{FILI}]$') THEN 'orphan-fili' WHEN NOT regexp_matches(c[i], '^[{CONSONANT}{FILI}]') THEN 'non-thaana' "
        f"WHEN length(c[i]) = 1 AND NOT (c[i] = '{NOONU}' AND i < len(c) AND regexp_matches(c[i + 1], '^[{PRENASAL_FOLLOWERS}]')) THEN 'missing-fili' END"
    )
    each = f"list_transform(range(1, len(c) + 1), lambda i: struct_pack(index := coalesce(length(array_to_string(c[1:i - 1], '')), 0), code := {code}))"
    return f"(SELECT list_filter({each}, lambda e: e.code IS NOT NULL) FROM (SELECT {c} AS c))"


#: What a structure error says, by code.
STRUCTURE_MESSAGE = {"missing-fili": "consonant without a vowel sign or sukun", "orphan-fili": "vowel sign without a consonant", "non-thaana": "character outside the script"}


def is_well_formed(word: Column) -> Column:
    return F.size(structure_errors(word)) == 0


#: A word is well formed if each consonant has a sign, but for a noonu before its followers. The sign-less
#: noonu is removed first, as RE2 has no look-ahead.
def is_well_formed_sql(word: str) -> str:
    return f"regexp_full_match(regexp_replace({word}, '{NOONU}([{PRENASAL_FOLLOWERS}])', '\\1', 'g'), '([{CONSONANT}][{FILI}])*')"


# --- confusions and length pairs ----------------------------------------------------------

LENGTH_MAP = {a: b for x, y in LENGTH_PAIRS for a, b in ((x, y), (y, x))}
_SHORT_LONG = ("".join(LENGTH_MAP), "".join(LENGTH_MAP.values()))


def length_partner(fili: Column) -> Column:
    """The sign of the other length, or null."""
    return F.when(fili.isin(*LENGTH_MAP), F.translate(fili, *_SHORT_LONG))


def confusion_group(consonant: Column) -> Column:
    """The number of the consonant's confusion set, or null."""
    out = F.lit(None).cast("int")
    for k, group in enumerate(CONFUSION_SETS):
        out = F.when(consonant.isin(*group), k).otherwise(out)
    return out


def same_confusion_set(a: Column, b: Column) -> Column:
    """Whether two consonants are in one confusion set."""
    return F.coalesce(confusion_group(a) == confusion_group(b), F.lit(False))


def explained(errors: Column) -> Column:
    """structure_errors() with a message each."""
    messages = F.create_map(*(F.lit(x) for kv in STRUCTURE_MESSAGE.items() for x in kv))
    return F.transform(errors, lambda e: F.struct(e.index.alias("index"), e.code.alias("code"), messages[e.code].alias("message")))


def deletes(keys: Column, allowed: Column) -> Column:
    """The distinct unit strings left after removing up to `allowed` (0 to 2) units, the whole among them."""
    join = lambda a: F.array_join(a, "")
    drop = lambda a, i: F.filter(a, lambda x, j: j != i)
    pos = lambda a: F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))
    one = lambda a: F.transform(pos(a), lambda i: join(drop(a, i)))
    two = lambda a: F.flatten(F.transform(pos(a), lambda i: F.transform(F.filter(pos(a), lambda k: k > i), lambda k: join(F.filter(a, lambda x, j: (j != i) & (j != k))))))
    empty = F.array().cast("array<string>")
    return let(keys, lambda a: F.array_distinct(F.concat(F.array(join(a)), F.when(allowed >= 1, one(a)).otherwise(empty), F.when(allowed >= 2, two(a)).otherwise(empty))))


def edits_allowed(keys: Column) -> Column:
    """One edit for up to two units, else two."""
    return F.when(F.size(keys) <= 2, 1).otherwise(2)
