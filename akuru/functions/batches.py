"""Arrow batches of texts: transliteration, runs and counted pairs.

No step of the transliteration looks across a space, so what stands between spaces is transliterated once a slice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import script as S

#: Bytes of text worked on at once; pairs counted together before they are sent on.
SLICE, PAIRS = 2 << 20, 1_000_000

_WORKING = re.compile(f"[{S._WORKING}]+|[^{S._WORKING}]+")
_HAS_WORKING = re.compile(f"[{S._WORKING}]")
_ZERO_WIDTH = re.compile(f"[{S.ZERO_WIDTH}]")
_NO_ZERO_WIDTH = str.maketrans("", "", S.ZERO_WIDTH)


def _marked(text: str, mark: str) -> str:
    """mark after every consonant; replacements are faster than a regular expression."""
    for c in S._C.values():
        text = text.replace(c, c + mark)
    return text


def _step(kind: str, a: str, b: str):
    if kind == "chars":
        assert not set(a) & set(b)  # so one after the other is as good as all at once, and many times faster than str.translate

        def each(s: str) -> str:
            for x, y in zip(a, b, strict=True):
                s = s.replace(x, y)
            return s

        return each
    if kind == "text":
        return lambda s: s.replace(a, b)
    if "\\p{L}" in a:  # Python's re has no such class; the letter h ends a word where none follows
        new = b.removesuffix("\\1")

        def ending(m: re.Match) -> str:
            after = m.string[m.end() : m.end() + 1]
            return m[0] if after and (after.isalpha() or _HAS_WORKING.match(after)) else new

        candidate = re.compile(f"h(?![A-Za-z{S._WORKING}])")
        return lambda s: candidate.sub(ending, s)
    if a == "([\uE000-\uE03F])":
        return lambda s: _marked(s, b.removeprefix("\\1"))
    pattern = re.compile(a)
    return lambda s: pattern.sub(b, s)


_STEPS = [_step(*x) for x in S._translit_steps()]


def _chain(text: str) -> str:
    for step in _STEPS:
        text = step(text)
    return text


def latin_to_thaana(text: str) -> str:
    """script.latin_to_thaana() of one text."""
    if _HAS_WORKING.search(text):
        return "".join(r if _HAS_WORKING.match(r) else _chain(r) for r in _WORKING.findall(text))
    return _chain(text)


def chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Where each text's chunks begin, each chunk's number, and the distinct chunks; texts has no nulls."""
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy(zero_copy_only=False)
    return offsets - offsets[0], coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def thaana_chunks(distinct: list[str]) -> list[str]:
    """The transliterated chunks, all in one go."""
    return latin_to_thaana(" ".join(distinct)).split(" ") if distinct else []


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of some SLICE bytes, a row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + SLICE, "right")))
        yield at, end
        at = end


def transliterated(texts: pa.Array) -> pa.Array:
    """script.latin_to_thaana() of texts without nulls."""
    offsets, codes, distinct = chunks(texts)
    written = pa.array(thaana_chunks(distinct.to_pylist()), pa.string())
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), written.take(pa.array(codes))), " ")


def distinct_sorted(a: np.ndarray) -> np.ndarray:
    """np.unique() by sorting, which is faster for large arrays than NumPy's hash table."""
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


class Cut:
    """Texts cut in runs of Thaana and what is between them: each distinct segment once, and all segments by number.

    bounds: where each text's segments begin; codes: what each segment is; run: which segments are runs; text: their texts.
    """

    def __init__(self, texts: pa.Array) -> None:
        texts = pa.concat_arrays([texts])
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2] or pa.py_buffer(b"")
        b = np.frombuffer(data, np.uint8)
        b = np.append(b[: offsets[-1]], np.zeros(2, np.uint8)) if len(texts) else np.zeros(2, np.uint8)
        # in UTF-8 the script's code points are DE 80 to DE B1, zero-width joiners E2 80 8C and E2 80 8D
        two = np.flatnonzero(b[:-2] == 0xDE)
        two = two[(b[two + 1] >= 0x80) & (b[two + 1] <= 0xB1)]
        three = np.flatnonzero(b[:-2] == 0xE2)
        three = three[(b[three + 1] == 0x80) & ((b[three + 2] == 0x8C) | (b[three + 2] == 0x8D))]
        inside = np.zeros(len(b), bool)
        for at, n in ((two, 2), (three, 3)):
            for k in range(n):
                inside[at + k] = True
        cut = np.zeros(len(b), bool)
        cut[offsets[0] + 1 : offsets[-1]] = inside[offsets[0] + 1 : offsets[-1]] != inside[offsets[0] : max(offsets[-1] - 1, offsets[0])]
        cut[offsets] = True
        cuts = np.flatnonzero(cut)
        self.bounds = np.searchsorted(cuts, offsets)
        segments = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), data) if len(cuts) > 1 else pa.array([], pa.string())
        coded = segments.dictionary_encode()
        self.codes, self.distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        self.run = inside[cuts[:-1]]
        self._places()

    def _places(self) -> None:
        self.text = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        at = np.flatnonzero(self.run)
        #: Where each text's runs begin, and each run's place among all segments of its text.
        self.first_run = np.searchsorted(at, self.bounds)
        self.no = at - self.bounds[self.text[at]]

    def words(self) -> pa.Array:
        """The distinct segments without zero-width joiners."""
        if not pc.any(pc.match_substring_regex(self.distinct, f"[{S.ZERO_WIDTH}]")).as_py():
            return self.distinct
        return pa.array([x.translate(_NO_ZERO_WIDTH) if _ZERO_WIDTH.search(x) else x for x in self.distinct.to_pylist()], pa.string())

    def packed(self) -> tuple[list[pa.Array], pa.ListArray]:
        """What unpacked() takes: by text its first segment's kind, runs and gaps; all distinct segments at the first text."""
        gaps = np.concatenate([[0], np.cumsum(~self.run)])[self.bounds]
        some = np.diff(self.bounds) > 0
        lead = np.zeros(len(some), bool)
        lead[some] = self.run[self.bounds[:-1][some]]
        lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(self.codes[kind], pa.int32())) for o, kind in ((self.first_run, self.run), (gaps, ~self.run))]
        return [pa.array(lead), *lists, pa.ListArray.from_arrays(pa.array([0] + [len(self.distinct)] * len(some), pa.int32()), self.distinct)]

    @classmethod
    def unpacked(cls, lead: pa.Array, runs: pa.ListArray, gaps: pa.ListArray, distinct: pa.ListArray) -> Cut:
        self = cls.__new__(cls)
        sizes = np.diff(runs.offsets.to_numpy()) + np.diff(gaps.offsets.to_numpy())
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        text = np.repeat(np.arange(len(sizes)), sizes)
        self.run = (np.arange(len(text)) - self.bounds[text]) % 2 == np.where(lead.to_numpy(zero_copy_only=False), 0, 1)[text]
        self.codes = np.empty(len(text), np.int32)
        self.codes[self.run], self.codes[~self.run] = runs.flatten().to_numpy(), gaps.flatten().to_numpy()
        self.distinct = distinct.flatten()
        self._places()
        return self

    def rewritten(self, used: np.ndarray, syns: pa.Array, spans: bool) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array] | tuple[pa.Array]:
        """The texts with syns[used] for runs (-1: the word itself, or a run without one as it stands); with spans each run's start and end in code points, and what is written."""
        words = self.words()
        own = words if words is self.distinct else pc.if_else(pc.equal(words, ""), self.distinct, words)
        strings = pa.concat_arrays([own, syns])
        is_word = np.zeros(len(own), bool)
        is_word[self.codes[self.run]] = True
        if own is not self.distinct:
            strings = pa.concat_arrays([pc.if_else(pa.array(is_word), own, self.distinct), syns])
        stream = self.codes.astype(np.int64)
        written = np.where(used >= 0, used + len(own), stream[self.run])
        stream[self.run] = written
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(self.bounds, pa.int32()), strings.take(pa.array(stream))), "")
        if not spans:
            return (text,)
        lengths = pc.utf8_length(strings).to_numpy(zero_copy_only=False).astype(np.int64)[stream]
        total = np.concatenate([[0], np.cumsum(lengths)])
        end = total[1:][self.run] - total[self.bounds[self.text[self.run]]]
        return text, end - lengths[self.run], end, strings.take(pa.array(written))


def counted(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(w1, w2s, cnts) of transliterated texts: words that follow w1, joined by spaces, and how often each does; the first is empty and stands for w1 itself."""
    numbers: dict[str, int] = {"": 0}  # of words
    held, size = [], 0

    def out() -> Iterator[pa.RecordBatch]:
        names = pa.array([*numbers])
        pairs, counts = np.unique(np.concatenate(held), return_counts=True)
        first = pairs >> 32
        starts = np.flatnonzero(np.diff(first, prepend=-1))
        offsets = pa.array([*starts.tolist(), len(pairs)], pa.int32())
        follow = pc.binary_join(pa.ListArray.from_arrays(offsets, names.take(pa.array(pairs & 0xFFFFFFFF))), " ")
        whole = pa.RecordBatch.from_arrays([names.take(pa.array(first[starts])), follow, pa.ListArray.from_arrays(offsets, pa.array(counts))], schema=schema)
        for at in range(0, len(whole), 20_000):
            yield whole.slice(at, 20_000)

    for batch in batches:
        texts = batch.column(0).fill_null("")
        for at, end in slices(texts):
            cut = Cut(transliterated(texts.slice(at, end - at)))
            codes = cut.codes[cut.run]
            own, codes = np.unique(codes, return_inverse=True)
            named = cut.words().take(pa.array(own)).to_pylist()
            words = np.fromiter((numbers.setdefault(w, len(numbers)) for w in named), np.int64, len(named))[codes]
            kept = words > 0  # a run of joiners only is no word
            words, text = words[kept], cut.text[cut.run][kept]
            same = text[1:] == text[:-1]
            held += [words << 32, (words[:-1][same] << 32) | words[1:][same]]
            size += len(words)
            if size >= PAIRS:
                yield from out()
                numbers, held, size = {"": 0}, [], 0
                pa.default_memory_pool().release_unused()
    if size:
        yield from out()
