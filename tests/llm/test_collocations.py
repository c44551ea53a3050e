"""Collocations against a plain count of every phrase."""

import random
import re
from collections import Counter

import pytest
from hard_rows import hard, nothing  # noqa: F401
from pyspark.sql import functions as F

from lakesync.llm import collocations as c

A_TO_Z = {chr(k): chr(k + 32) for k in range(65, 91)}


def brute(rows, top, least):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang, text = lang or "und", (text or "").translate(str.maketrans(A_TO_Z))
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i:i + k])] += 1
    out = []
    for lang, found in counts.items():
        kept = []
        for phrase, a in found.items():
            if len(phrase) == 1 or a < least:
                continue
            if len(phrase) == 2 and any(100 * f >= 50 * a for p, f in found.items() if len(p) == 3 and f >= least and phrase in (p[:2], p[1:])):
                continue
            score, _, left, right = min((10**6 * a * a // (found[phrase[:k]] * found[phrase[k:]]), k, found[phrase[:k]], found[phrase[k:]]) for k in range(1, len(phrase)))
            kept.append((-score, -a, " ".join(phrase).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def texts(n, seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a\x01", "a", "New", "york", "city", "naïve", "漢字", "x\x00y", "b"]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 60)):
            parts.append("New York City" if rng.random() < 0.1 else "the " * rng.randint(1, 4) if rng.random() < 0.2 else rng.choice(words))
            parts.append(rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\x0b", " "]))
        rows.append((rng.choice(["en", "en", "en", None, "und", "fr"]), "".join(parts)))
    return rows


@pytest.mark.parametrize("partitions", [1, 9])
def test_equals_a_plain_count(spark, rows, monkeypatch, partitions):
    monkeypatch.setattr(c, "BLOCK_BYTES", 700)  # many blocks, so that counts meet in Spark
    data = texts(120, 3) + [(None, None), ("en", ""), ("fr", " ".join(["long way home"] * 400))]
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(data)], "doc_id long, lang string, text string").repartition(partitions)
    for top, least in ((2000, 10), (7, 3)):
        assert rows(c.collocations(docs, top, least)) == sorted(brute(data, top, least), key=repr)


def test_a_full_sieve_changes_nothing(spark, rows, monkeypatch):
    """With a sieve of a few bits nearly all phrases are false alarms."""
    monkeypatch.setattr(c, "SIEVE_BITS", c.BITMAP)
    monkeypatch.setattr(c, "_slots", lambda hashes: (hashes % 3).astype("int64"))
    data = texts(60, 5)
    docs = spark.createDataFrame(data, "lang string, text string")
    assert rows(c.collocations(docs)) == sorted(brute(data, 2000, 10), key=repr)


def test_counts_carry_over_ranges(spark):
    """One word begins nearly all phrases, so that its ranges begin without it."""
    stream = [("en", "hot", None, None, 900_000)] + [("en", "hot", f"w{k:04}", None, 100 + k) for k in range(900)]
    stream += [("en", "hot", "w0500", f"v{k:03}", 20) for k in range(300)]
    frame = spark.createDataFrame(stream, "lang string, w1 string, w2 string, w3 string, f long").repartition(8)
    conf = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        walked = c.walk_in_order(frame, ["w1", "w2", "w3"], "one", "two").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", conf)
    assert len(walked) == len(stream)
    for r in walked:
        assert r["one"] == (None if r["w2"] is None else 900_000) and r["two"] == (None if r["w3"] is None else 600)


def test_scores_are_exact(spark):
    cases = [(10**12, 10**12, 10**12), (999_999_999_989, 10**12 + 39, 10**12 + 61), (10, 3_000_000_000, 10), (7, 7, 7), (10**14 + 1, 10**14 + 7, 10**14 + 9)]
    frame = spark.createDataFrame(cases, "a long, l long, r long").select(c.cut_score(F.col("a"), F.col("l"), F.col("r")).alias("s"), "a", "l", "r")
    for r in frame.collect():
        assert r["s"] == 10**6 * r["a"] ** 2 // (r["l"] * r["r"])


def test_hard_rows(hard, nothing, rows):
    got = rows(c.collocations(hard))
    assert got == sorted(brute([(r["lang"], r["text"]) for r in hard.select("lang", "text").collect()], 2000, 10), key=repr)
    assert c.collocations(nothing).collect() == []
    assert c.collocations(hard.limit(0)).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
