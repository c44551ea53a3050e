import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lakesync.llm import ppm
from lakesync.llm.common import fold_of
from hard_rows import hard, nothing  # noqa: F401


def by_hand(rows):
    """Score all rows with plain dictionaries."""
    words, grams = Counter(), [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
    marked = lambda t: ppm.START * ppm.ORDER + (t or "").encode().lower() + ppm.END
    for doc, text in rows:
        if zlib.crc32(str(doc).encode()) % 7 != 2:
            words.update([*(text or "").encode().lower().split(), None])
            m = marked(text)
            for i in range(ppm.ORDER, len(m)):
                grams[ppm.ORDER][m[i - ppm.ORDER: i]][m[i]] += 1
    for k in range(ppm.ORDER - 1, -1, -1):
        for context, found in grams[k + 1].items():
            for symbol in found:
                grams[k][context[1:]][symbol] += 1

    def logp(context, symbol):
        out, excluded = 0.0, set()
        for k in range(ppm.ORDER, -1, -1):
            found = grams[k].get(context[ppm.ORDER - k:])
            if found is None:
                continue
            left = {s: n for s, n in found.items() if s not in excluded}
            if symbol in left:
                return out + math.log10((left[symbol] - 0.5) / sum(left.values()))
            if left:
                out += math.log10(0.5 * len(left) / sum(left.values()))
            excluded |= set(found)
        return out - math.log10(256 - len(excluded))

    n, v = sum(words.values()), len(words)
    for doc, text in rows:
        m, tokens = marked(text), [*(text or "").encode().lower().split(), None]
        yield (doc, len(tokens), sum(words[w] > 0 for w in tokens), n, sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens),
               sum(logp(m[i - ppm.ORDER: i], m[i]) for i in range(ppm.ORDER, len(m))))


@pytest.mark.parametrize("most, bits", [(1 << 19, 21), (40, 6)])
def test_equals_dictionaries(spark, most, bits):
    rows = [(k, " ".join(f"{'ab' * (k % 5)}c{(k * j) % 13}É" for j in range(k % 23)) + "\n" * (k % 3)) for k in range(60)] + [(60, None), (61, ""), (62, "§ΩΩ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in ppm.score(docs, fold_of("doc_id", 7) != 2, most, bits).collect()}
    for doc, tokens, known, n, base, score in by_hand(rows):
        r = got[doc]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (tokens, known, n)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)
        assert r["held_out"] == (zlib.crc32(str(doc).encode()) % 7 == 2)


def test_grams_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    texts = [b"abcabcabd" * 40, b"", b"x"]
    whole = [np.concatenate(x) for x in zip(*ppm.pieces(texts))]
    monkeypatch.setattr(ppm, "PIECE", 7)
    cut = [np.concatenate(x) for x in zip(*ppm.pieces(texts))]
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut)) and len(whole[0]) == 360 + 1 + 1 + 2


def test_hash_table():
    rng = np.random.default_rng(1)
    keys, values = np.unique(rng.integers(-2**62, 2**62, 5000)), None
    values = rng.normal(size=len(keys))
    table = ppm.HashTable(keys, values, 12)
    found, kept = table.find(np.concatenate([keys, keys + 1]))
    assert kept[: len(keys)].sum() > 2500 and not kept[len(keys):].any()
    assert np.array_equal(found[: len(keys)][kept[: len(keys)]], values[kept[: len(keys)]])


def test_hard_rows(spark, hard, nothing):
    rows = ppm.score(hard, fold_of("doc_id", 7) != 2).collect()
    assert len(rows) == hard.count() and all(r["score"] < 0 for r in rows)
    assert all(r["n_tokens"] == 1 for r in rows if r["doc_id"] in (3, 4, 5))
    from pyspark.sql import functions as F

    untrained = {r["doc_id"]: r["score"] for r in ppm.score(hard, F.col("doc_id") < 0).collect()}
    assert untrained[9] == pytest.approx(-2 * math.log10(256))
    assert ppm.score(nothing, fold_of("doc_id", 7) != 2).count() == 0
