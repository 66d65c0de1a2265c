import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from akuru.llm import packing, tokenfile
from akuru.llm.common import scratch_path
from akuru.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>b c", "plain words only", "almost <|endoftext|", "hello world <|endoftext|>"]


def library_ids(text):
    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_encoder_equals_library_as_the_file_sets_it():
    encoder = Encoder(PATH)
    for text in TEXTS * 2:
        assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == library_ids(text)
    assert library_ids(TEXTS[0]) == [31373, 220, 50256, 995]


def test_token_output_and_packing(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    path = scratch_path(spark, "added")
    tokenfile.write(docs, PATH, path)
    got = tokenfile.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("c")).orderBy("doc_id").collect()
    at = 0
    for row, text in zip(got, TEXTS, strict=True):
        ids = [*library_ids(text), 2]
        assert tuple(row) == (row.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    cut = {r.doc_id: r.doc_tokens for r in packing.cut(docs, PATH).collect()}
    assert cut[0] - cut[3] == len(library_ids(TEXTS[0])) - len(library_ids(TEXTS[3]))
