"""Ranked search against scores of every document."""

import math
import random
import re
from collections import Counter

import pytest
from hard_rows import hard, nothing  # noqa: F401

from lakesync.llm import ranked_search as s

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
A_TO_Z = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def terms(text):
    return [t.translate(A_TO_Z) for t in TERM.findall(text or "")]


def brute(docs, items, top):
    rows = [(i, Counter(terms(text))) for i, text in docs]
    rows = [(i, c, sum(c.values())) for i, c in rows if c]
    n_docs, all_terms = len(rows), sum(n for *_, n in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    out = []
    for item, text in items:
        scored = []
        for at, (i, c, n) in enumerate(rows):
            m = 10 + 90 * n * n_docs // all_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score:
                scored.append((-score, i is None, i or 0, at))
        out += [(item, rank, None if none else i, -score) for rank, (score, none, i, _) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def sample(n, seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(3000)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    docs = [(k, text(rng.randint(0, 120))) for k in range(n)]
    docs += [(10_000 + k, docs[5][1]) for k in range(40)]  # many equal scores at the cut
    docs += [(None, docs[7][1]), (3, docs[3][1]), (3, docs[3][1]), (7_777, None), (7_778, "--- ,;")]
    items = [(k, text(rng.randint(1, 30))) for k in range(25)] + [(100, docs[5][1]), (101, None), (102, "unknown"), (None, docs[7][1]), (100, "w1"), (103, "W1 w1")]
    return docs, items


@pytest.mark.parametrize(("postings", "portion"), [(s.BLOCK_POSTINGS, s.PORTION_TERMS), (400, 40)])
def test_equals_all_scores(spark, rows, monkeypatch, postings, portion):
    monkeypatch.setattr(s, "BLOCK_POSTINGS", postings)
    monkeypatch.setattr(s, "PORTION_TERMS", portion)
    docs, items = sample(400, 2)
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).repartition(3) if portion == s.PORTION_TERMS else spark.createDataFrame(docs, "doc_id long, text string")
    queries = spark.createDataFrame(items, "item_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        got = sorted((tuple(r) for r in s.search(frame, queries).collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(docs, items, 10)


def test_reads_stop_early_and_scores_are_exact():
    """Against sums over the whole lists, for many random lists with ties."""
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(60):
        documents, n_terms = 200, int(rng.integers(1, 9))
        place, term, impact = [], [], []
        for t in range(n_terms):
            held = rng.choice(documents, int(rng.integers(0, documents)), replace=False)
            place.append(held), term.append(np.full(len(held), t)), impact.append(rng.integers(1, 5 * 10 ** int(rng.integers(0, 6)) + 1, len(held)))
        place, term, impact = (np.concatenate(x).astype(np.int64) for x in (place, term, impact))
        lists = s._Lists(place, term, impact)
        scores = np.zeros(documents, np.int64)
        np.add.at(scores, place, impact)
        places, got = s.search_block(lists, list(range(n_terms)), documents, 5)
        least = max(1, np.sort(scores)[-5])
        want = np.flatnonzero(scores >= least)
        assert set(places[got >= least]) == set(want) and (scores[places] == got).all()


def test_terms():
    text = "Ab_c-1 ÄÖ\x00x 漢字🙂 \x7fZ don't"
    assert [t.decode() for t in s.terms_of(text)] == terms(text)
    assert s.terms_of(None) == []


def test_hard_rows(hard, nothing, spark):
    items = [(1, "alpha beta words"), (2, "w1 w2 w3 idiot ärger Ärger"), (3, None), (4, "x")]
    queries = spark.createDataFrame(items, "item_id long, text string")
    docs = [(r["doc_id"], r["text"]) for r in hard.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in s.search(hard, queries).collect()), key=repr) == brute(docs, items, 10)
    assert s.search(nothing, queries).collect() == [] and s.search(hard, queries.limit(0)).collect() == []
