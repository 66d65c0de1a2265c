import math
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from akuru.llm import licenses, queries


def brute(files, threshold=licenses.THRESHOLD):
    """files: (key, path, text). Everything compared with everything, nothing skipped."""
    toks = lambda t: re.findall("[a-z0-9]+", t.lower())
    n = len(files)
    df = Counter(t for _, _, x in files for t in set(toks(x or "")))
    vocab = {t for _, x in licenses.TEMPLATES for t in toks(x)}
    idf = lambda t: math.log((1 + n) / (1 + df[t])) + 1 if t in vocab else math.log(1 + n) + 1

    def unit(ts):
        v = {t: c * idf(t) for t, c in Counter(ts).items()}
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {t: w / norm for t, w in v.items()} if norm else {}

    templates = [(s, unit(toks(x))) for s, x in licenses.TEMPLATES]
    own, dirs = {}, {}
    for i, (_, path, text) in enumerate(files):
        found, words = [], 0
        cut = lambda x: re.sub(r"([.!?])[ \t\r]+", r"\1\n", x).split("\n")
        lines = [x if re.search("[a-z0-9]", x) else "" for x in (text or "").lower().split("\n")]
        paragraphs = [p for p in re.split("\n\n+", "\n".join(lines)) if "\n" in p]
        for sentences in (cut((text or "").lower()), [x for p in paragraphs for x in cut(p.replace("\n", " "))]):
            said = 0
            for x in sentences:
                v = unit(toks(x))
                best = max(((round(sum(w * t.get(y, 0) for y, w in v.items()), 6), spdx) for spdx, t in templates), default=None) if v else None
                if best and best[0] >= threshold:
                    found.append(best)
                    said += len(toks(x))
            words = max(words, said)
        if found:
            own[i] = max(found)
            folder, _, name = (path or "").rpartition("/")
            if path is not None and (re.match(licenses.LICENCE_FILE, name) or 2 * words >= len(toks(text))):
                folder = "/".join(p for p in folder.split("/") if p)
                dirs[folder] = max(dirs.get(folder, (0, "")), own[i])
    out = []
    for i, (key, path, _) in enumerate(files):
        if i in own:
            out.append((key, path, own[i][1], own[i][0], "own", None))
            continue
        parts = [p for p in path.rpartition("/")[0].split("/") if p] if path is not None else None
        near = next((d for k in range(len(parts), -1, -1) if (d := "/".join(parts[:k])) in dirs), None) if parts is not None else None
        out.append((key, path, *(dirs[near][::-1] if near is not None else (None, None)), "inherited" if near is not None else None, near))
    return out


def order(rows):
    return sorted(rows, key=repr)


def test_whole_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    below = lambda r: [r.lang] * (r.doc_id % 3 >= 1) + [f"d{r.doc_id % 7}"] * (r.doc_id % 3 == 2)
    files = [(r.doc_id, "/".join([r.source, *below(r), str(r.doc_id)]), r.text) for r in docs]
    got = queries.op8_license_scan(spark, sf).collect()
    assert order(map(tuple, got)) == order(brute(files))
    # the climb is exercised: some inherit from a directory above their own
    assert sum(r.origin == "inherited" and r.licensed_dir != r.path.rpartition("/")[0] for r in got) > 20


MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
"""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version {} of the License, or
# (at your option) any later version.
#
import os
"""
APACHE_FILE = """
                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
"""
APACHE = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 */
int main() { return 0; }
"""


def test_wrapped_headers_and_licence_files(spark):
    texts = {"MIT": MIT, "BSD-3-Clause": BSD, "GPL-3.0": GPL.format(3), "GPL-2.0": GPL.format(2).replace("software:", "software;").replace("Foundation, either", "Foundation; either"), "Apache-2.0": APACHE}
    files = [(f"{k}/src.c", t) for k, t in texts.items()] + [("apache/LICENSE", APACHE_FILE), ("apache/a/b/c.py", "x = 1")]
    files += [(f"plain/{k}", f"some words of file {k}\nand a line") for k in range(40)]
    got = {r.path: r for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert {k: got[f"{k}/src.c"].license for k in texts} == {k: k for k in texts}
    assert all(got[f"{k}/src.c"].score > 0.95 for k in texts)
    assert (got["apache/a/b/c.py"].license, got["apache/a/b/c.py"].origin, got["apache/a/b/c.py"].licensed_dir) == ("Apache-2.0", "inherited", "apache")
    assert order((r.path, r.path, r.license, r.score, r.origin, r.licensed_dir) for r in got.values()) == order(brute([(p, p, t) for p, t in files]))


def test_a_long_line_is_scored_in_time(spark):
    """20,000 words of one line, template terms among them, in seconds."""
    words = [t for _, x in licenses.TEMPLATES for t in licenses.terms(x)]
    line = " ".join(words[k % len(words)] if k % 3 else f"word{k}" for k in range(20_000))
    df = spark.createDataFrame([("a", line)], "path string, text string")
    licenses.scan(df.limit(0)).collect()
    began = time.time()
    assert licenses.scan(df).count() == 1
    assert time.time() - began < 8


def test_more_directories_than_are_broadcast(spark, monkeypatch):
    mit = "Released under the MIT License."
    files = [("a/LICENSE", mit), ("a/b/c", "x"), ("d/e", "y"), (None, "z"), ("LICENSE2/f", None)]
    df = spark.createDataFrame(files, "path string, text string")
    want = order(map(tuple, licenses.scan(df).collect()))
    monkeypatch.setattr(licenses, "BROADCAST_DIRS", 0)
    assert order(map(tuple, licenses.scan(df).collect())) == want


def test_inheritance_and_edge_rows(spark):
    mit, apache = "Released under the MIT License.", "Code.\nLicensed under the Apache License, Version 2.0."
    files = [
        (1, "LICENSE", mit), (2, "a/b/c.py", "x = 1"), (3, "a/COPYING.txt", "words " * 50 + "\n" + apache), (4, "a/b/d/e.py", None), (5, "z.py", ""),
        (6, None, "nothing here"), (7, None, mit), (8, "/a//b/f.py", "text"), (8, "/a//b/f.py", "text"), (9, "q/g.py", "long text " * 20_000 + apache), (None, "q/h.py", "h"),
    ]
    df = spark.createDataFrame(files, "key long, path string, text string").withColumn("license", F.lit("clash"))
    got = licenses.scan(df, key="key")
    assert order(map(tuple, got.collect())) == order(brute(files))
    by = {r.key: r for r in got.collect()}
    assert by[2].license == "Apache-2.0" and by[5].license == "MIT" and by[6].license is None and by[9].origin == "own" and by[None].license == "MIT"


@pytest.mark.parametrize("rows", [[]])
def test_empty(spark, rows):
    assert licenses.scan(spark.createDataFrame(rows, "path string, text string")).count() == 0


def test_needed_terms_bound_the_cosine():
    v = [("x", {"a": 0.8, "b": 0.5, "c": 0.33})]
    assert licenses.needed_terms(v, 0.75) == ["a"] and licenses.needed_terms(v, 0.5) == ["a", "b"]
