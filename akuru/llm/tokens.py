"""Exact, fast encoding with a byte-level BPE file of the tokenizers library.

The library's model does the merges; this module only spares it repeated work. A text is cut
at single spaces between two non-space characters, where the file's own pre-tokenizer always
cuts, and the ids of a chunk are remembered. Texts with any other kind of space next to a space
go to the library whole, as do texts that hold an added token and files of any other make-up.
Many texts at once are cut and their chunks made distinct by Arrow, so that Python meets a chunk once for all its occurrences.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Callable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks that one generation of the memo holds; two generations are kept (about 150 bytes a chunk).
MEMO = 150_000
#: Bytes of text that are encoded together, about (see encode_many).
TOGETHER = 4_000_000
#: The pre-tokenizer's pattern, in terms of Python's re. Only used for chunks in which both agree.
_PIECES = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters for which re's classes and the pattern's agree: Basic Latin, and the letters of Latin-1 and Latin Extended-A.
_PLAIN = re.compile("[\x21-\x7e\nÀ-ÖØ-öø-ſ]*")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Texts with a line break beside other space, or at their end.
_BROKEN = r"[\n\t\r\f]\n|\n[\t\r\f]|\n\z"
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ſ]+")
_LETTERS_MARKS = re.compile("([A-Za-zÀ-ÖØ-öø-ſ]+)([!-/:-@\\[-`{-~]+)")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _strings(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


def _gather(ids: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries after each other in ids, those named, and their sizes."""
    n = sizes[which]
    place = np.repeat((np.cumsum(sizes) - sizes)[which] - (np.cumsum(n) - n), n)
    place += np.arange(len(place))
    return ids.take(place), n


class Words:
    """A memo of words' ids in arrays; two generations of about ``most`` words are kept, and what is met goes to the younger one."""

    def __init__(self, dtype: np.dtype, most: int) -> None:
        self.most, self.empty = most, ({}, np.zeros(0, dtype), np.zeros(0, np.int64))
        self.new = self.old = self.empty

    def find(self, words: list[str], learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words after each other, and their numbers. learn() gives the same for words not met before."""
        if len(self.new[0]) > self.most:
            self.old, self.new = self.new, self.empty
        at, ids, sizes = self.new
        at = at or {}
        places = list(map(at.get, words))
        missing = [k for k, place in enumerate(places) if place is None]
        if missing:
            before, old_ids, old_sizes = self.old
            kept = [before.get(words[k]) for k in missing]
            known = [k for k, place in zip(missing, kept, strict=True) if place is not None]
            fresh = [k for k, place in zip(missing, kept, strict=True) if place is None]
            again = _gather(old_ids, old_sizes, np.array([place for place in kept if place is not None], np.int64))
            learnt = learn([words[k] for k in fresh]) if fresh else self.empty[1:]
            for place, k in enumerate(known + fresh, len(at)):
                at[words[k]] = places[k] = place
            ids, sizes = np.concatenate([ids, again[0], learnt[0]]), np.concatenate([sizes, again[1], learnt[1]])
        self.new = at, ids, sizes
        return _gather(ids, sizes, np.array(places, np.int64))


class Encoder:
    """encode(text) gives the ids of a whole text as little-endian bytes of ``dtype``."""

    def __init__(self, path: str, memo: int = MEMO) -> None:
        self.memo = memo
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.vocabulary = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=size) + 1
        self.dtype = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        made = json.loads(self.tokenizer.to_str())
        pre = made.get("pre_tokenizer") or {}
        self.plain = sys.byteorder == "little" and made.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", False) and not pre.get("add_prefix_space") and made["model"]["type"] == "BPE"
        self.added = [t["content"] for t in made.get("added_tokens") or ()]
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.space = self.letters[0x20]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        # no token joins a word to a following word of Latin letters, which starts with one of these bytes
        starts = "".join(self.letters[b] for b in (*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, 0xC4, 0xC5))
        across = re.compile(f"[^{self.space}]{self.space}+([{starts}]|\\Z)")
        self.apart = not any(across.search(w) for w in vocabulary)
        self.leads = np.zeros(self.vocabulary, bool)
        self.leads[[i for w, i in vocabulary.items() if w.startswith(self.space)]] = True
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.words = Words(self.dtype, memo)
        self.line_break = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype).tobytes()

    def _word(self, piece: str) -> bytes:
        """Ids of one piece of Latin letters or punctuation, with a leading space or none."""
        if piece.isascii():
            piece = piece.replace(" ", self.space)
        else:
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _chunk(self, chunk: str) -> bytes | None:
        """Ids of a space followed by chunk; None if a cut beside it would not be one of the library's."""
        if chunk.strip() != chunk or not chunk:
            return None
        if _LETTERS.fullmatch(chunk):
            return self._word(" " + chunk)
        if m := _LETTERS_MARKS.fullmatch(chunk):
            core, marks = m.groups()
            return (self.new.get(core) or self.old.get(core) or self._word(" " + core)) + self._piece(marks)
        if not _PLAIN.fullmatch(chunk):
            return self.whole(" " + chunk)
        return b"".join([self._piece(p) for p in _PIECES.findall(" " + chunk)])

    def _piece(self, piece: str) -> bytes:
        ids = self.marks.get(piece)
        if ids is None:
            ids = self.whole(piece) if "\n" in piece else self._word(piece)
            if len(piece) <= 64:
                self.marks[piece] = ids
        return ids

    def _head(self, head: str) -> bytes | None:
        """Ids of a chunk that no space precedes; None if a cut behind it would not be one of the library's."""
        ids = self.heads.get(head)
        if ids is None and head and head.strip() == head:
            m = _LETTERS_MARKS.fullmatch(head)
            ids = self._word(m[1]) + self._piece(m[2]) if m else self._word(head) if _LETTERS.fullmatch(head) else self.whole(head)
            if len(head) <= 64:
                self.heads[head] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not self.plain or "  " in text or any(t in text for t in self.added):
            return self.whole(text) if text else b""
        head, *rest = text.split(" ")
        first = self._head(head)
        if first is None:
            return self.whole(text) if text else b""
        out = list(map(self.new.get, rest))
        if None in out and not self._learn(rest, out):
            return self.whole(text)
        return first + b"".join(out)

    def encode_many(self, texts: pa.Array, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of some texts after each other, each text's followed by end_id, and their numbers; no text may be null."""
        texts = texts.cast(pa.large_string())  # room for the spaces that are put in
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right")))
            yield self._together(texts.slice(at, to - at), end_id)
            at = to

    def _together(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        holds = lambda mark: pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        odd = reduce(np.logical_or, map(holds, ("  ", *self.added)), np.full(len(texts), not self.plain))
        # a line break with no other space beside it is a piece of its own: lines are cut, too, and all but a text's first begin with it
        lines, broken = pc.replace_substring(texts, "\n", " \n"), pc.match_substring_regex(texts, _BROKEN)
        if pc.any(broken).as_py():
            lines = pc.if_else(broken, texts, lines)
            odd |= holds(" \n")
        pieces = pc.split_pattern(pc.if_else(pa.array(odd), "", lines), " ")
        edges = pieces.offsets.to_numpy().astype(np.int64)
        firsts, behind = edges[:-1], edges[1:]
        heads = list(map(self._head, pieces.values.take(pieces.offsets[:-1]).to_pylist()))
        named = pieces.values.dictionary_encode()
        codes, chunks = named.indices.to_numpy().astype(np.int64), len(named.dictionary)
        codes[firsts] = chunks + np.arange(len(heads))
        ids, sizes, lost = self._chunks(named.dictionary)
        # entries: the distinct chunks, the start of each text (all of it, if it is odd), its end, and nothing
        end, nothing = chunks + len(heads), chunks + len(heads) + 1
        odd = np.fromiter((h is None for h in heads), bool, len(heads))
        if lost.any():
            odd |= np.logical_or.reduceat(np.append(lost, np.zeros(len(heads), bool))[codes], firsts)
        if odd.any():
            codes[np.repeat(odd, behind - firsts)] = nothing
            codes[firsts] = chunks + np.arange(len(heads))
            for k in np.flatnonzero(odd).tolist():
                text = texts[k].as_py()
                heads[k] = self.whole(text) if text else b""
        more, more_sizes = self._joined([*heads, np.array([end_id], self.dtype).tobytes(), b""])
        flat, n = _gather(np.append(ids, more), np.append(sizes, more_sizes), np.insert(codes, behind, end))
        return flat, np.add.reduceat(n, firsts + np.arange(len(heads)))

    def _joined(self, some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(some), self.dtype), np.fromiter(map(len, some), np.int64, len(some)) // self.dtype.itemsize

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct chunks, their numbers, and which must not be cut off (see _chunk); one that begins a line has its line break."""
        if len(self.heads) + len(self.marks) > self.memo:
            self.heads.clear(), self.marks.clear()
        cores = pc.utf8_rtrim(chunks, characters=_MARKS)
        is_word = pc.match_substring_regex(cores, f"^{_LETTERS.pattern[:-1]}{{1,64}}$").to_numpy(zero_copy_only=False) & self.apart
        words = cores.filter(pa.array(is_word)).dictionary_encode()
        trimmed = np.where(is_word, pc.subtract(pc.binary_length(chunks), pc.binary_length(cores)).to_numpy(), 0)
        marked = np.flatnonzero(trimmed)
        marks: dict[str, int] = {}
        mark = [marks.setdefault(c[-k:], len(marks)) for c, k in zip(_strings(chunks.take(pa.array(marked))), trimmed[marked].tolist(), strict=True)]
        others = self._others(_strings(chunks.filter(pa.array(~is_word))))
        lost = np.zeros(len(chunks), bool)
        lost[~is_word] = [x is None for x in others]

        word_ids, word_sizes = self.words.find(_strings(words.dictionary), self._words)
        more, more_sizes = self._joined([*(x or b"" for x in others), *map(self._piece, marks), b""])
        first, second = np.empty(len(chunks), np.int64), np.full(len(chunks), len(word_sizes) + len(others) + len(marks))
        first[is_word] = words.indices.to_numpy()
        first[~is_word] = len(word_sizes) + np.arange(len(others))
        second[marked] = len(word_sizes) + len(others) + np.array(mark, np.int64)
        flat, n = _gather(np.append(word_ids, more), np.append(word_sizes, more_sizes), np.column_stack([first, second]).ravel())
        return flat, n.reshape(-1, 2).sum(axis=1), lost

    def _others(self, chunks: list[str]) -> list[bytes | None]:
        """Ids of distinct chunks; None for those that must not be cut off."""
        ids: list[bytes | None] = [None] * len(chunks)
        rest = []
        for k, chunk in enumerate(chunks):
            if chunk[:1] == "\n":
                line = self._head(chunk[1:])
                ids[k] = None if line is None else self.line_break + line
            elif chunk and chunk.strip() == chunk:
                rest.append(k)
        if rest:
            found: list[bytes | None] = [None] * len(rest)
            self._learn([chunks[k] for k in rest], found)
            for k, one in zip(rest, found, strict=True):
                ids[k] = one
        return ids

    def _learn(self, chunks: list[str], out: list[bytes | None]) -> bool:
        """Fill in the ids that out lacks; False if a chunk must not be cut off (see _chunk)."""
        places, k = [], -1
        for _ in range(out.count(None)):
            k = out.index(None, k + 1)
            places.append(k)
        if len(self.new) > self.memo:
            self.old, self.new = self.new, {}
        if len(self.heads) + len(self.marks) > self.memo:
            self.heads.clear(), self.marks.clear()
        new, old = self.new, self.old
        words, marked, long = [], [], {}
        for chunk in dict.fromkeys([chunks[k] for k in places]):
            ids = old.get(chunk)
            if ids is not None:
                new[chunk] = ids
            elif self.apart and len(chunk) <= 64 and _LETTERS.fullmatch(chunk):
                words.append(chunk)
            elif self.apart and len(chunk) <= 64 and (m := _LETTERS_MARKS.fullmatch(chunk)):
                core, marks = m.groups()
                marked.append((chunk, core, marks))
                if core not in new:
                    ids = old.get(core)
                    if ids is None:
                        words.append(core)
                    else:
                        new[core] = ids
            else:
                ids = self._chunk(chunk)
                if ids is None:
                    return False
                (new if len(chunk) <= 64 else long)[chunk] = ids
        if words:
            words = list(dict.fromkeys(words))
            ids, sizes = self._words(words)
            raw, at = ids.tobytes(), 0
            for word, end in zip(words, (np.cumsum(sizes) * self.dtype.itemsize).tolist(), strict=True):
                new[word] = raw[at:end]
                at = end
        for chunk, core, marks in marked:
            new[chunk] = new[core] + self._piece(marks)
        for k in places:
            chunk = chunks[k]
            ids = new.get(chunk) or long.get(chunk) or old.get(chunk)
            if ids is None:  # the generations have changed under a chunk met before
                ids = self._chunk(chunk)
            out[k] = ids
        return True

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of Latin letters after each other, and their numbers, many in one call.

        No token of the file goes on across a space into such a word (``apart``), so no merge does.
        """
        ids: list[int] = []
        for k in range(0, len(words), 100):
            text = " " + " ".join(words[k : k + 100])
            text = text.replace(" ", self.space) if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
            ids += [t.id for t in self.model.tokenize(text)]
        flat = np.array(ids, dtype=self.dtype)
        return flat, np.diff(np.flatnonzero(self.leads[flat]), append=len(flat))


@cache
def encoder(path: str, memo: int = MEMO) -> Encoder:
    """One encoder per Python process and file."""
    return Encoder(path, memo)
