import random
import zlib

import numpy as np

from lakesync.llm import toxicity
from hard_rows import hard, nothing  # noqa: F401


def test_margins_equal_all_pairs():
    rng = np.random.default_rng(0)
    model = toxicity.Machine(0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    rows = [[], [3], [1, 5, 7], list(range(20))]
    for row, score in zip(rows, model.scores(rows)):
        margin = 0.3 + sum(model.weights[i] for i in row) + sum(model.factors[i] @ model.factors[j] for i in row for j in row if i < j)
        assert np.isclose(score, 1 / (1 + np.exp(-np.clip(margin, -40, 40))))


def test_learns_a_pair_that_no_single_term_tells():
    random.seed(1)
    rows, labels = [], []
    for _ in range(3000):
        a, b = random.random() < 0.5, random.random() < 0.5
        rows.append([0] * a + [1] * b + [2 + random.randrange(5)])
        labels.append(float(a and b) if random.random() < 0.99 else 0.0)
    model = toxicity.fit(rows, np.array(labels), 7)
    scores = model.scores([[0, 1], [0], [1], []])
    assert scores[0] > 0.9 and scores[1:].max() < 0.3


def test_train_learns_a_pair_without_marginal_effect(spark):
    """Each of the two words stands in half of the toxic and half of the clean texts; only both or neither of them tell."""
    random.seed(3)
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    rows, labels = [], []
    for i in range(2400):
        a, b = random.random() < 0.5, random.random() < 0.5
        rows.append((i, " ".join(random.sample(words, 10) + ["martians"] * a + ["vermin"] * b)))
        labels.append((i, int(a == b)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model, terms = toxicity.train(docs, marks)
    scored = docs.select("doc_id", toxicity.score(docs["text"], model, terms).alias("s")).collect()
    held = [(r["s"] >= 0.5, labels[r["doc_id"]][1]) for r in scored if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum(p == bool(y) for p, y in held) >= 0.97 * len(held)


def test_held_out_accuracy(spark):
    random.seed(2)
    insults = ["idiot", "scum", "moron"]
    rows, labels = [], []
    for i in range(1500):
        toxic = random.random() < 0.2
        words = [f"word{random.randrange(300)}" for _ in range(random.randrange(5, 80))]
        for _ in range(2 * toxic):
            words.insert(random.randrange(len(words)), random.choice(insults) + random.choice(["", "ic", "ish"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model, terms = toxicity.train(docs, marks)
    from pyspark.sql import functions as F

    score = {r["doc_id"]: r["s"] for r in docs.select("doc_id", toxicity.score(F.col("text"), model, terms).alias("s")).collect()}
    held = [(score[i] >= toxicity.THRESHOLD, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(p == bool(y) for p, y in held) >= 0.97 * len(held)
    assert not any(p and not y for p, y in held)
    kept = {r["doc_id"] for r in toxicity.accepted_documents(docs, marks).collect()}
    assert kept == {i for i in score if score[i] < toxicity.THRESHOLD}


def test_labels_of_the_held_out_fold_are_not_read(spark):
    rows = [(i, f"bad{i % 4}" if i % 2 else f"good{i % 4}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    right = [(i, i % 2) for i in range(300)]
    wrong = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in right]
    a, b = (toxicity.train(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (right, wrong))
    assert a[1] == b[1] and np.array_equal(a[0].weights, b[0].weights) and a[0].bias == b[0].bias


def test_hard_rows(spark, hard, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (4, 0), (99, 0)], "doc_id long, toxic int")
    assert toxicity.accepted_documents(hard, none).count() == hard.count()
    assert toxicity.accepted_documents(hard, odd).columns == hard.columns
    assert toxicity.accepted_documents(nothing, odd).count() == 0


def test_terms_equal_plain_counts_whatever_words_are_kept(monkeypatch):
    monkeypatch.setattr(toxicity, "KEPT", 20)
    random.seed(5)
    texts = [None, "", "1 2"] + [" ".join(random.choice(["spam", "spams", "spamming", f"w{chr(97 + k % 26)}rd"]) for k in range(n)) for n in range(60)]

    def by_hand(text):
        times = {}
        for word in (text or "").split():
            if word.isalpha():
                for stem in [f"{word}$", *(word[:n] for n in toxicity.BEGINNINGS if len(word) >= n)]:
                    times.setdefault(zlib.crc32(stem.encode()) & toxicity._MASK, []).append(word)
        found = set()
        for stem, words in times.items():
            found |= {(stem + level * toxicity.STEP) & toxicity._MASK for level in toxicity.LEVELS if level <= len(words)}
        return sorted(found)

    terms = toxicity.Terms()
    for _ in range(2):
        for k in range(0, len(texts), 7):
            found, starts = terms.of(texts[k: k + 7])
            assert [found[a:b].tolist() for a, b in zip(starts, starts[1:])] == [by_hand(t) for t in texts[k: k + 7]]
            assert isinstance(terms["spam"], int) and len(terms.ends) == len(terms) + 1  # numbers, not lists of stems of each word
    known = np.array(sorted({t for text in texts for t in by_hand(text)})[::2], "<i4")
    found, starts = toxicity.Terms(known.tobytes()).of(texts)
    assert [known[found[a:b]].tolist() for a, b in zip(starts, starts[1:])] == [[t for t in by_hand(text) if t in known] for text in texts]


def test_places_are_bits(spark):
    rng = np.random.default_rng(3)
    known = np.unique(np.concatenate([rng.integers(0, 1 << toxicity.HASH_BITS, 5000), [0, (1 << toxicity.HASH_BITS) - 1]])).astype("<i4")
    places = toxicity.Places(known)
    asked = np.concatenate([rng.permutation(known), rng.integers(0, 1 << toxicity.HASH_BITS, 5000)]).astype(np.int64)
    there, numbers = places.of(asked)
    plain = {t: k for k, t in enumerate(known.tolist())}
    assert [(i, plain[t]) for i, t in enumerate(asked.tolist()) if t in plain] == list(zip(there.tolist(), numbers.tolist()))
    lookup = toxicity.Terms(known.tobytes())
    held = sum(x.nbytes for x in (lookup.places.bits, lookup.places.before)) + len(lookup.stems)
    assert held <= 6 << 20  # 80 MB with a number and a byte for each term
    assert len(toxicity.Places(known[:0]).of(asked)[0]) == 0
