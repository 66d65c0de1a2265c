import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from akuru.llm import tokenfile, tokens
from akuru.llm.common import scratch_path
from akuru.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = [
    "", " ", "\n", "a", "a\nb", "a\n\nb", "a \nb", "a\n b", "a\nb\n", "\na b", "\na\n\nb", "a\r\nb c", "a\tb\n\tc d", "a\fb\n\fc\f\nd", " a b", "a b ", "a  b", "a \nb", "a\n b c", "a b  c", "a\x1c\nb",
    "a <|endoftext|>\nb", "<|endoftext|>", "line one.\nLine two, it's\n\"quoted\" (so)\n555-2830\nmail@x.example\nÉté, ça ira.\nẞtraße\n中文 字\nа б", "don't 'tis we'll\n'tis 'll\n's x", "word, word. word! word,", "\U0001f600 \U0001f600\n\U0001f600",
    "w" * 64 + " " + "w" * 65 + " " + "w" * 64 + ".\n" + "w" * 65, "x_y\n_z __ \\ ` ^", "½ ² x²\n²", "ſ ſſ. Āž\nſ",
]


def library(text):
    return [*LIBRARY.encode(text, add_special_tokens=False).ids, 2]


def many(encoder, texts):
    out = []
    for flat, sizes in encoder.encode_many(pa.array(texts, pa.string()), 2):
        assert flat.dtype == encoder.dtype and len(flat) == sizes.sum()
        out += [flat[to - n : to].tolist() for n, to in zip(sizes, np.cumsum(sizes), strict=True)]
    return out


@pytest.mark.parametrize("together", [1, 40, 8_000_000])
def test_ids_are_those_of_the_library(monkeypatch, together):
    monkeypatch.setattr(tokens, "TOGETHER", together)
    encoder = Encoder(PATH)
    for _ in range(2):  # remembered the second time
        assert many(encoder, TEXTS) == [library(t) for t in TEXTS]
    assert many(encoder, []) == []


@pytest.mark.parametrize("memo", [3, 200])
def test_random_texts_with_a_memo_that_turns_over(monkeypatch, memo):
    monkeypatch.setattr(tokens, "TOGETHER", 2000)
    rng = random.Random(memo)
    parts = ["the", "The", "of", "Été", "é", "a1", "12", "...", ",", "'s", "_", " ", " ", " ", " ", "\n", "\n", "\t", "\r", "　", "日", "<|endoftext|>", "straße"]
    texts = ["".join(rng.choices(parts, [4] * 5 + [2] * 6 + [9] * 4 + [2, 2, 0.1, 0.1, 0.1, 1, 0.1, 2], k=rng.randrange(40))) for _ in range(1500)]
    encoder = Encoder(PATH, memo)
    assert many(encoder, texts) == [library(t) for t in texts]


def test_other_files_go_to_the_library_whole(tmp_path):
    other = Tokenizer.from_file(PATH)
    from tokenizers import pre_tokenizers

    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    other.save(str(tmp_path / "t.json"))
    assert many(Encoder(str(tmp_path / "t.json")), TEXTS) == [[*other.encode(t, add_special_tokens=False).ids, 2] if t else [2] for t in TEXTS]


def test_a_word_is_met_once_for_all_its_occurrences():
    encoder, met = Encoder(PATH), Counter()
    learn = encoder._words
    encoder._words = lambda words: met.update(words) or learn(words)
    encoder.encode = None  # not by single texts
    texts = ["some words, and more.\nSome words"] * 300
    assert many(encoder, texts) == [library(t) for t in texts]
    assert met["words"] == 1 and set(met.values()) == {1}


def test_token_files_of_odd_texts(spark):
    path = scratch_path(spark, "many")
    docs = spark.createDataFrame([(7 * k % len(TEXTS), TEXTS[7 * k % len(TEXTS)]) for k in range(len(TEXTS))], "doc_id long, text string")
    tokenfile.write(docs, PATH, path)
    got = tokenfile.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("c")).orderBy("doc_id").collect()
    at, want = 0, []
    for k in range(len(TEXTS)):
        ids = library(TEXTS[k])
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
