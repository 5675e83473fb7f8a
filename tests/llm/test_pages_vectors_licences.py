"""Operators 4, 5 and 6."""

import hashlib
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from forgeline.llm import licenses, top_k, warc

RECORD = "WARC/1.0\r\nWARC-Type: response\r\nX-Page-Id: 99\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
BIG = "x" * 1200
PAGES = [
    (1, "u", BIG), (2, "u", BIG), (3, None, BIG), (3, None, BIG), (4, "u", None), (5, "u", ""),
    (6, "u", f"a{RECORD}b"), (7, "u", RECORD), (8, "u", "é\r\n\r\nWARC/1.0\r\n"), (9, "u", "WARC/1.0\r\nWARC/1.0\r\n"),
    (10, "u", "WWARC/1.0\r\n\r\n"), (11, "u\r\nContent-Length: 5", f"{BIG}é"), (12, "u", f"{BIG}é"),
    (13, "u", "small"), (14, "u", "small"), (15, "u", RECORD * 3 + BIG), (16, "u", RECORD * 3 + BIG), (None, "u", "n"),
]


def wanted(pages):
    out = Counter()
    for key, _, html in pages:
        body = (html or "").encode()
        keeper = max((k for k, _, h in pages if (h or "") == (html or "") and k is not None), default=None)
        other = len(body) >= 1000 and key != keeper
        out[key, len(body), hashlib.sha1(body).hexdigest(), "revisit" if other else "response", keeper if other else None] += 1
    return out


@pytest.mark.parametrize("compression,tasks", [("gzip", 1), ("gzip", 4), ("none", 1), ("none", 3)])
def test_archives_come_back_whole(rows, spark, tmp_path, compression, tasks):
    pages = rows("page_id bigint, url string, html string, type int, digest int", *[(*p, 1, 1) for p in PAGES])
    folder = str(tmp_path / "warc")
    warc.write_archives(pages.coalesce(tasks), folder, compression=compression)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:  # many tasks per file where it can be split
        spark.conf.set(names[0], "300")
        spark.conf.set(names[1], "1")
        got = warc.read_archives(spark, folder, payloads=True).collect()
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
    assert Counter((r.page, r.payload_bytes, r.payload_digest, r.type, r.refers_to) for r in got) == wanted(PAGES)
    bodies = {k: (h or "").encode() for k, _, h in PAGES}
    assert all(bytes(r.payload) == bodies[r.page] for r in got if r.type == "response")


def test_round_trip(rows):
    schema = "page_id bigint, url string, html string"
    got = warc.round_trip(rows(schema, *PAGES)).drop("offset").collect()
    assert Counter(map(tuple, got)) == wanted(PAGES)
    assert warc.round_trip(rows(schema)).count() == 0


def test_pointer_jumping_reaches_only_the_chain():
    mark = len(warc.MAGIC)
    # pieces of 10 bytes; the third mark is inside the second record
    size = np.array([0, 10, 10, 10, 10])
    needs = np.array([-1, 10, 20 + mark, 10, 10])
    offset, true = warc.reachable(size, needs)
    assert true.tolist() == [False, True, True, False, True]
    assert offset[1] == 0 and offset[2] == 10 + mark
    # a record that runs past the end, and a file that doesn't begin with a mark
    assert not warc.reachable(np.array([0, 10]), np.array([-1, 11]))[1].any()
    assert not warc.reachable(np.array([3, 10]), np.array([-1, 10]))[1].any()


def search_brute(data, k):
    usable = []
    for place, (key, v) in enumerate(data):
        if key is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((place, key, [math.floor(64 * float(np.float32(x))) for x in v]))
    out = Counter()
    for place, key, q in usable:
        if key % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, c)), other) for p, other, c in usable if p != place)
            for rank, (score, other) in enumerate(found[:k], 1):
                out[key, rank, other, -score] += 1
    return out


@pytest.mark.parametrize("high,candidates,queries,seeds", [(0.6, 8192, 2048, 2048), (0.0, 40, 3, 30), (2.0, 40, 3, 5), (0.3, 7, 2, 60)])
def test_search_equals_brute_force(monkeypatch, rows, high, candidates, queries, seeds):
    monkeypatch.setattr(top_k, "HIGH_COSINE", high)
    monkeypatch.setattr(top_k, "CANDIDATES", candidates)
    monkeypatch.setattr(top_k, "QUERIES", queries)
    monkeypatch.setattr(top_k, "SEEDS", seeds)
    draw = np.random.default_rng(1)
    vectors = draw.normal(size=(300, 8)) * draw.choice([0.01, 0.3, 1, 3], size=(300, 1))
    vectors[100:110] = vectors[0]
    vectors[5] = 0
    data = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(vectors)]
    data += [(20, data[3][1]), (None, data[1][1]), (400, None), (401, [1.0, None]), (420, [float("nan")] * 8)]
    data += [(421, [float("inf")] * 8), (440, data[7][1][:5]), (460, []), (-20, data[9][1])]
    table = rows("vec_id bigint, embedding array<float>, score int, uid int", *[(*d, 1, 1) for d in data])
    got = top_k.search(table, F.col("vec_id") % 20 == 0, k=7)
    assert Counter(map(tuple, got.collect())) == search_brute(data, 7)


def test_search_finds_all_in_partitions_left_apart(monkeypatch, spark, rows):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    monkeypatch.setattr(top_k, "QUERIES", 3)
    draw = np.random.default_rng(2)
    data = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(draw.normal(size=(200, 4)))]
    try:
        spark.conf.set(name, "false")
        got = top_k.search(rows("vec_id bigint, embedding array<float>", *data), F.col("vec_id") % 20 == 0, k=7)
        assert Counter(map(tuple, got.collect())) == search_brute(data, 7)
    finally:
        spark.conf.set(name, before)


def test_search_of_few_or_none(rows):
    schema = "vec_id bigint, embedding array<float>"
    few = rows(schema, (0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0]))
    got = top_k.search(few, F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 2048), (0, 2, 2, 2048)]
    assert top_k.search(rows(schema), F.col("vec_id") % 20 == 0).count() == 0
    assert top_k.search(rows(schema, (1, [1.0])), F.col("vec_id") % 20 == 0).count() == 0


FILES = [
    (1, "p/LICENSE", "Released under the MIT License"),
    (2, "p/src/a/x.py", "code\nwithout notice"),
    (3, "p/src/LICENSE", "Licensed under the Apache License, Version 2.0"),
    (4, "p/y.py", "some code " * 30 + "\nThis work is licensed under the GNU General Public License, version 3.\nmore"),
    (5, "q/z.py", "nothing here"),
    (6, "top.py", None),
    (7, "p/empty", ""),
    (8, None, "Licensed under CC BY-NC 4.0."),
    (9, "p/src/b.py", "the license of this version is public knowledge in general"),
    (2, "p/src/a/x.py", "code\nwithout notice"),
]


def test_licences_and_inheritance(rows, stored):
    schema = "doc_id bigint, path string, text string, license int, term int"
    found = licenses.scan(stored(rows(schema, *[(*f, 1, 1) for f in FILES])))
    got = Counter((r.doc_id, r.license, r.origin, r.inherited_from) for r in found.collect())
    assert got == Counter(
        [
            (1, "MIT", "file", None), (2, "Apache-2.0", "inherited", "p/src"), (2, "Apache-2.0", "inherited", "p/src"),
            (3, "Apache-2.0", "file", None), (4, "GPL-3.0", "header", None), (5, None, None, None), (6, None, None, None),
            (7, "MIT", "inherited", "p"), (8, "CC-BY-NC-4.0", "file", None), (9, "Apache-2.0", "inherited", "p/src"),
        ]
    )
    assert licenses.scan(stored(rows("doc_id bigint, path string, text string"))).count() == 0


def test_licence_scan_equals_sql(rows, stored, prose):
    draw = random.Random(6)
    notices = [body for _, body in licenses.TEMPLATES]
    data = []
    for k in range(120):
        text = prose(k, draw.randint(0, 30))
        if draw.random() < 0.4:
            text += "\n" + draw.choice(notices) + draw.choice(["", ".", " or so", " and more of the same license"])
        data.append((k, text, draw.choice(["en", "de"]), draw.choice(["a", "b", "c"])))
    docs = stored(rows("doc_id bigint, text string, lang string, source string", *data))
    got = licenses.scan(docs.withColumn("path", F.concat_ws("/", "source", "lang", "doc_id")))
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = Counter(con.execute(licenses.oracle_sql()).fetchall())
    assert Counter(map(tuple, got.collect())) == want
    assert len({r[3] for r in want}) >= 3


SHORT = [
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright 2021 Somebody. All rights reserved."),
    ("Proprietary", "All rights reserved. No part may be reproduced without permission."),
    ("MIT", "Copyright 2021 Somebody. All rights reserved.\nReleased under the MIT license (the MIT license of old)"),
    (None, "Seats are reserved."),
    (None, "reserved\n\n\n\n\nrights"),
]


@pytest.mark.parametrize("common", [0, 40])
def test_short_notices_on_a_line_by_themselves(rows, stored, prose, common):
    data = [(k, f"d{k}/f", f"{prose(k, 30)}\n{notice}\n{prose(-k, 30)}") for k, (_, notice) in enumerate(SHORT)]
    data += [(1000 + k, f"e{k}/f", f"{prose(k, 30)} rights of way") for k in range(common)]
    found = licenses.scan(stored(rows("doc_id bigint, path string, text string", *data))).filter("doc_id < 1000")
    got = {r.doc_id: (r.license, r.origin) for r in found.collect()}
    assert got == {k: (name, name and "header") for k, (name, _) in enumerate(SHORT)}


GNU = """ * This {0} is free software: you can redistribute it and/or modify
 * it under the terms of the GNU {1}General Public
 * License as published by the Free Software Foundation, either
 * version {2} of the License, or (at your option) any later version."""
WRAPPED = [
    ("GPL-3.0", GNU.format("program", "", 3)),
    ("GPL-2.0", GNU.format("program", "", 2)),
    ("LGPL-3.0", GNU.format("library", "Lesser ", 3)),
    ("LGPL-2.1", GNU.format("library", "Lesser ", "2.1")),
    ("AGPL-3.0", "Copyright A. All rights reserved.\n" + GNU.format("program", "Affero ", 3)),
    ("MPL-2.0", "# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy is not"),
    ("MIT", "// Permission is hereby granted, free of charge, to any\n// person obtaining a copy of this software"),
    ("BSD-3-Clause", "Redistribution and use in source and\nbinary forms, with or without\nmodification, are permitted"),
    (None, "the general public\nhas no license\nfor this version"),
]


def test_whole_licence_texts_and_wrapped_notices(rows, stored, prose):
    def rewrap(text, width):
        words = text.split()
        return "\n".join(" ".join(words[k : k + width]) for k in range(0, len(words), width))

    texts = licenses.whole_texts()
    data, want = [], {}
    for k, (name, text) in enumerate(texts):
        data.append((f"f{k}", f"p{k}/LICENSE", "Copyright (c) 2019 Some Body <some@body.org>\n\n" + rewrap(text, 5 + k)))
        data.append((f"i{k}", f"p{k}/src/x.py", prose(k, 40)))
        # the same text within a longer file grants nothing
        data.append((f"s{k}", f"q{k}/x.py", f"{text}\n" + "\n".join(f"a{n} = b{n * 7} + c{n * k}" for n in range(1200))))
        data.append((f"n{k}", f"q{k}/y.py", prose(k, 40)))
        want |= {f"f{k}": (name, "file"), f"i{k}": (name, "inherited"), f"n{k}": (None, None)}
    for k, (name, notice) in enumerate(WRAPPED):
        data.append((f"w{k}", f"w{k}/x.py", f"{prose(k, 60)}\n{notice}\n{prose(-k, 60)}"))
        want[f"w{k}"] = name, name and "header"
    found = licenses.scan(stored(rows("doc_id string, path string, text string", *data))).collect()
    got = {r.doc_id: (r.license, r.origin) for r in found}
    assert {k: v for k, v in got.items() if not k.startswith("s")} == want
    assert all(v[1] != "file" for k, v in got.items() if k.startswith("s"))
    assert len(got) == len(data)
