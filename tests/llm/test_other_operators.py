"""WARC, Hamming search, chats, licences and the pipeline: odd input, round trips, oracles."""

import glob
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF_SMALL
from llm_fixtures import no_docs, odd_docs  # noqa: F401
from larder.llm import chat, hamming, licenses, queries, warc
from larder.llm.common import table
from larder.session import scratch_path

NAMES = ["op2_benchmark_decontamination", "op5_warc_archives", "op7_hamming_top_k", "op9_chat_formatting"]


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in "documents pages benchmark embeddings conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t + '.parquet')}')")
    df = queries.queries()[name](spark, SF_SMALL)
    res = con.execute(queries.oracle_sql()[name])
    at = [[d[0] for d in res.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in res.fetchall()), key=repr)


def test_warc_round_trip_and_format(spark):
    page = "<html>" + "x" * 200 + " é</html>"
    noise = lambda i: "".join(random.Random(i).choices("abcdefgh <>/", k=400))
    rows = [(3, "http://a/ b\r\nc", page), (1, "u", page), (2, None, page), (2, None, page), (4, "u", "tiny"), (5, "u", "tiny"), (6, "u", None), (7, "u", ""), (None, "u", page)]
    rows += [(100 + i, f"http://h/{i}", noise(i)) for i in range(60)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    path = scratch_path(spark, "warc-test")
    got = warc.archive_pages(spark, pages.repartition(2), path).collect()
    assert len(got) == len(rows)
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got if (r.page_id or 0) < 100)
    assert kinds == [(0, "revisit", 1), (1, "response", None), (2, "revisit", 1), (2, "revisit", 1), (3, "revisit", 1), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None)]
    by_id = {r[0]: r[2] or "" for r in rows}
    assert all(bytes(r.payload).decode() == by_id[r.page_id] for r in got if r.record_type == "response")
    # The files by the format alone: leading dictionary frame, one frame per record.
    total = 0
    for name in glob.glob(path.removeprefix("file:") + "/part-*"):
        data = open(name, "rb").read()
        assert data[:4] == warc.DICT_MAGIC
        dictionary, records = warc.archive_stream([data])
        assert dictionary
        total += sum(warc.parse_record(r)["payload_bytes"] >= 0 for r in records)
    assert total == len(rows)
    assert warc.archive_pages(spark, pages.limit(0)).count() == 0


def test_hamming_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=40).tolist()) for i in range(700)] + [(i, [1.0] * 40) for i in range(700, 1100)]
    rows += [(None, [1.0] * 40), (2000, None), (2001, [1.0, None]), (20, rows[20][1])]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, code int")
    codes = sorted({(i, tuple([int((x or 0) > 0) for x in v] + [0] * (40 - len(v)))) for i, v in rows if i is not None and v is not None})
    bits = np.array([c for _, c in codes])
    want = []
    for i, c in codes:
        if i % 20 == 0:
            order = sorted((int((bits[j] != np.array(c)).sum()), codes[j][0]) for j in range(len(codes)))[:10]
            want += [(i, n + 1, b, d) for n, (d, b) in enumerate(order)]
    got = hamming.top_k(spark, vectors, index_block=200, query_block=30)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert hamming.top_k(spark, vectors.limit(0)).count() == 0


def test_chats(spark):
    long = [("user", f"t{i}") for i in range(25)]
    convs = {1: long[:3], 2: long, 3: long, 4: long[:1] + [("user", "else")], 5: [(None, None)], 6: [("user", "a<|im_end|>b")], None: long[:2]}
    rows = [(c, t, r, x, "clash") for c, turns in convs.items() for t, (r, x) in enumerate(turns)]
    rows += [(1, 0, *long[0], "other"), (7, None, "user", "t0", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string")
    got = chat.format_chats(spark, df, block=10).collect()
    status = {(r.conv_id, r.n_turns, r.status, r.kept_in) for r in got}
    assert status == {(1, 3, "prefix", 2), (2, 25, "kept", None), (3, 25, "copy", 2), (4, 2, "kept", None), (5, 1, "kept", None), (6, 1, "kept", None), (7, 1, "prefix", 1), (None, 2, "prefix", 1)}
    text = "".join(r.text for r in sorted((r for r in got if r.conv_id == 2), key=lambda r: r.part))
    assert text == "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in long)
    assert [r.text for r in got if r.conv_id == 6] == ["<|im_start|>user\na< |im_end|>b<|im_end|>\n"]
    assert [r.text for r in got if r.conv_id == 5] == ["<|im_start|>unknown\n<|im_end|>\n"]
    assert chat.format_chats(spark, df.limit(0)).count() == 0


def test_licences(spark):
    model = licenses.fit(spark)
    notices = [(f, t) for f, ts in licenses.TEMPLATES.items() for t in ts]
    rows = [(i, f"Some prose.\n{t}\nmore", f, "z") for i, (f, t) in enumerate(notices)]
    rows += [(1000 + i, s, "", "z") for i, s in enumerate(licenses.ORDINARY)]
    rows += [(2000, None, "", "z"), (2001, "", "", "z"), (2002, "mit der und\n" * 5000, "", "z"), (None, "Released under the MIT License.", "MIT", "z"), (0, rows[0][1], "Apache-2.0", "z"), (2003, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.", "CC-BY-NC,MIT", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, want string, row string")
    got, _ = licenses.scan(spark, docs, model)
    want = sorted((repr(r[0]), r[2]) for r in rows)
    assert sorted((repr(r.doc_id), r.licences) for r in got.collect()) == want
    assert licenses.scan(spark, docs.limit(0), model)[0].count() == 0
    documents = table(spark, SF_SMALL, "documents")
    found = queries.queries()["op10_licence_scan"](spark, SF_SMALL).join(documents, "doc_id")
    line = F.col("text").rlike("Released under the MIT License") | F.col("text").rlike("Licensed under|licensed under")
    assert found.where((F.col("licences") != "") != line).count() == 0


def test_pipeline(spark, odd_docs, no_docs):
    documents = table(spark, SF_SMALL, "documents")
    kept = corpus_pipeline.run(spark, SF_SMALL)
    assert kept.count() > 0 and kept.where("not parity or not round_trip").count() == 0
    ids = {r.doc_id for r in kept.collect()}
    judged = queries.queries()["op2_benchmark_decontamination"](spark, SF_SMALL)
    assert not ids & {r.doc_id for r in judged.where("contaminated").collect()}
    assert len(ids) == kept.count() <= documents.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (odd_docs, no_docs):
            out = stage(spark, docs, SF_SMALL)
            assert out.columns == docs.columns and out.count() <= docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, odd_docs, SF_SMALL).count() == odd_docs.count()


def test_chat_blocks_are_bounded_whatever_the_turn_numbers(spark):
    rows = [(None, None, "user", f"n{i:03}") for i in range(95)] + [(None, 7, "user", f"s{i:03}") for i in range(40)] + [(1, 5000 * i, "user", f"f{i:03}") for i in range(12)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    assert chat.turn_hashes(spark, df, "conv_id", "turn", "role", "text", 10).groupBy("key", "block").count().agg(F.max("count")).first()[0] == 10
    got = chat.format_chats(spark, df, block=10).collect()
    for conv, want in ((None, [r[3] for r in rows[95:135] + rows[:95]]), (1, [r[3] for r in rows[135:]])):
        parts = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.part)
        assert [r.part for r in parts] == list(range(-(-len(want) // 10))) and all(r.text.count("<|im_start|>") <= 10 for r in parts)
        assert "".join(r.text for r in parts) == "".join(f"<|im_start|>user\n{x}<|im_end|>\n" for x in want)


WRAPPED = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:""",
    "BSD": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:""",
    "GPL": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at""",
}


def test_wrapped_notices(spark):
    rows = [(i, f"Some prose.\n\n{t}\n\nmore", f) for i, (f, t) in enumerate(WRAPPED.items())]
    rows += [(10 + i, "\n".join(["/*", " *", *(" * " + x for x in t.split("\n")), " *", " */"]), f) for i, (f, t) in enumerate(WRAPPED.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, want string")
    got, _ = licenses.scan(spark, docs, licenses.fit(spark))
    assert {r.doc_id: r.licences for r in got.collect()} == {r[0]: r[2] for r in rows}
