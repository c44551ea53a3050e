import itertools
import zlib

import numpy as np
import pytest

from lakesync.llm import transcripts
from lakesync.llm.transcripts import STATES, Model, marker
from hard_rows import nothing  # noqa: F401


def test_markers():
    assert marker("User: hi") == ("user", 6) and marker("### Response:") == ("assistant", 13) and marker("<|system|>") == ("system", 10)
    assert marker("**Human:** hi")[0] == "user" and marker("[assistant] x")[0] == "assistant" and marker("Bob: hi") == ("other", 0)
    assert marker("a plain line: with a colon")[0] == "" and marker("") == ("", 0) and marker("users like it")[0] == ""


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(4)
    model = Model({("", "user"): 5, ("user", "assistant"): 9, ("assistant", "user"): 7}, {(k, "marker", ""): 4 + k for k in range(6)})
    for n in (1, 2, 4):
        emitted = rng.normal(size=(n, 6))

        def worth(path, before=-1):
            first = model.start if before < 0 else model.step[before]
            return first[path[0]] + sum(model.step[a, b] for a, b in zip(path, path[1:])) + sum(e[s] for e, s in zip(emitted, path))

        every = list(itertools.product(range(6), repeat=n))
        assert worth(model.decode(emitted, -1, -1)) == pytest.approx(max(map(worth, every)))
        some = [p for p in every if p[-1] == 1]
        assert worth(model.decode(emitted, 4, 1), 4) == pytest.approx(max(worth(p, 4) for p in some))
        best = model.summary(emitted)
        assert best[4, 1] == pytest.approx(max(worth(p, 4) for p in some))


def test_chunks_do_not_change_the_result_and_roles_come_back(spark):
    path = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{path}/conversations.parquet")
    pieces = transcripts.as_transcripts(table)
    model = transcripts.train(pieces.filter("conv_id % 5 <> 1"))
    whole = sorted(tuple(r) for r in transcripts.parse(pieces, model).select("conv_id", "position", "line", "role", "n_lines").collect())
    for most in (1, 3):
        merged = []
        for r in sorted(transcripts.parse(pieces, model, most=most).collect(), key=lambda r: (r["conv_id"], r["position"], r["line"])):
            if r["continues"]:
                merged[-1][-1] += r["n_lines"]
            else:
                merged.append([r["conv_id"], r["position"], r["line"], r["role"], r["n_lines"]])
        assert [tuple(r) for r in merged] == whole
    truth = {(r["conv_id"], r["turn"]): r["role"] for r in table.collect()}
    found = {(c, p): role for c, p, line, role, _ in whole if line == 0}
    assert sum(found.get(k) == role for k, role in truth.items()) >= 0.8 * len(truth)


def test_rendering(spark):
    rows = [("c", 0, "User: hello?\n\nmore"), ("c", 1, "Assistant: yes.\n"), (None, 0, "### Human:\nhi"), ("c", None, None)]
    turns = transcripts.parse(spark.createDataFrame(rows, "conv_id string, position long, text string"), Model({}, {})).collect()
    by = {(r["conv_id"], r["position"], r["role"]): r["rendered"] for r in turns}
    assert by["c", 0, "user"] == "<|user|>\nhello?\n\nmore\n<|end|>\n" and by["c", 1, "assistant"] == "<|assistant|>\nyes.\n<|end|>\n"
    assert by[None, 0, "user"] == "<|user|>\nhi\n<|end|>\n"


def test_hard_rows(spark, nothing):
    pieces = nothing.selectExpr("doc_id AS conv_id", "1L AS position", "text", "'user' AS role")
    model = transcripts.train(pieces)
    assert transcripts.parse(pieces, model).count() == 0
    rows = [(1, 0, "A: " + "x " * 50_000, "user"), (1, 0, "A: same", None), (1, 0, "A: same", "robot"), (2, 5, "", "user"), (2, 5, "", "user")]
    frame = spark.createDataFrame(rows, "conv_id long, position long, text string, role string").selectExpr("*", "1 AS part", "2 AS at", "3 AS best")
    turns = transcripts.parse(frame, transcripts.train(frame)).collect()
    assert sum(r["n_lines"] for r in turns) == 5 and {r["conv_id"] for r in turns} == {1, 2}


def test_the_query_reads_every_turn(spark):
    path = "/root/testdata/sf0.001"
    rows = transcripts.op6_transcripts(spark, path)
    turns = spark.read.parquet(f"{path}/conversations.parquet")
    assert {(r["conv_id"]) for r in rows.collect()} == {r["conv_id"] for r in turns.collect()}
    assert zlib.crc32(b"1") % transcripts.HELD_OUT_PARTS >= 0 and len(STATES) == 6
