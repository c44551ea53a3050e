import random

import numpy as np
import pytest

from lakesync.llm import near_dedup
from lakesync.llm.common import materialise
from lakesync.llm.links import components
from hard_rows import hard, nothing  # noqa: F401


def by_hand(rows, words, percent=80):
    """Components by comparing all pairs of sets of word runs."""
    def shingles(text):
        w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
        return {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    group = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for k, (i, a) in enumerate(sets):
            for j, b in sets[:k]:
                if a and b and 100 * len(a & b) >= percent * len(a | b) and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    return {i: (len(s), group[i]) for i, s in sets}


def corpus(seed, n):
    random.seed(seed)
    rows, base = [], []
    for i in range(n):
        if base and random.random() < 0.6:
            words = list(random.choice(base))
            for _ in range(random.randrange(0, 6)):
                words[random.randrange(len(words))] = f"new{random.randrange(10**6)}"
        else:
            words = [random.choice(["the", "of", "and", f"w{random.randrange(500)}"]) for _ in range(random.randrange(1, 60))]
        base.append(words)
        rows.append((i * 3 % n * 5 + i // n, " ".join(words)))
    return rows


@pytest.mark.parametrize("words, node", [(2, 64), (2, 3), (5, 64)])
def test_equals_all_pairs(spark, monkeypatch, words, node):
    monkeypatch.setattr(near_dedup, "NODE", node)
    rows = corpus(words + node, 250)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_components(docs, words).collect()}
    assert got == by_hand(rows, words)


def test_a_large_group_is_one_component(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "NODE", 8)
    random.seed(1)
    words = [f"w{k}" for k in range(200)]
    copies = []
    for i in range(300):
        own = list(words)
        own[random.randrange(200)] = f"x{i}"
        copies.append((1000 - i, " ".join(own)))
    got = near_dedup.near_components(spark.createDataFrame(copies, "doc_id long, text string"), 5).collect()
    assert {r["component_id"] for r in got} == {701} and sum(r["kept"] for r in got) == 1


def test_nodes_that_never_split_are_settled(spark, monkeypatch):
    """Sets that are alike but not enough: with two functions a tree and nodes of two, all of them reach the last level."""
    monkeypatch.setattr(near_dedup, "NODE", 2)
    monkeypatch.setattr(near_dedup, "COORDINATES", 4)
    monkeypatch.setattr(near_dedup, "FIRST_DEPTH", 1)
    rows = [(i, " ".join(["same"] + [f"a{k}" for k in range(40)] + [f"own{i}x{k}" for k in range(6)])) for i in range(40)]
    rows += [(100 + i, t + " more") for i, t in rows[:5]]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == by_hand(rows, 2)


def test_large_nodes_in_runs_and_settled_as_one(spark, monkeypatch):
    """A family that fills all nodes alike, with links of its own inside; nodes are cut into runs, and settled as one."""
    monkeypatch.setattr(near_dedup, "NODE", 4)
    monkeypatch.setattr(near_dedup, "RUN", 16)
    rows = [(i, " ".join([f"a{k}" for k in range(60)] + [f"own{i}x{k}" for k in range(10 if i % 3 else 2)])) for i in range(150)]
    rows += [(500 + i, t + " more") for i, t in rows[:30]]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == by_hand(rows, 2)


def test_regrouped_nodes_keep_all_pairs_and_cost_no_more(spark):
    node = lambda name, main, reps, others: [(name, main, r, main if r not in others else r, len(reps), len(others)) for r in reps]
    rows = node(1, 0, range(40), {1, 2, 3}) + node(2, 0, range(30), {1, 2, 3}) + node(3, 900, range(100, 140), {100}) + node(4, 900, range(140, 180), {140})
    df = spark.createDataFrame(rows, "node long, main long, rep long, component long, rows long, others long")
    groups = near_dedup._together(df)
    out = near_dedup._regrouped(df, groups).collect()
    members = {}
    for r in out:
        members.setdefault((r["as_one"], r["node"]), set()).add(r["rep"])
    assert members == {(True, 0): set(range(40)), (False, 3): set(range(100, 140)), (False, 4): set(range(140, 180))}
    assert {r["others"] for r in out if r["as_one"]} == {3} and len(out) == 120


def test_components_of_chains_stars_and_loops(spark):
    links = [(k, k + 1) for k in range(0, 200)] + [(1000, k) for k in range(1001, 1100)] + [(5000, 5001), (5001, 5002), (5002, 5000), (7, 7)]
    random.seed(3)
    random.shuffle(links)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[k] for k in range(201)} == {0} and {got[k] for k in range(1000, 1100)} == {1000} and got[5002] == 5000
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketch_agrees_with_likeness():
    hashes = near_dedup.WordHashes()
    a = near_dedup.shingle_set(" ".join(f"w{k}" for k in range(1000)), 1, hashes)
    b = near_dedup.shingle_set(" ".join(f"w{k}" for k in range(111, 1111)), 1, hashes)
    assert abs(np.mean(near_dedup.minwise(a) == near_dedup.minwise(b)) - 889 / 1111) < 0.12
    assert len(near_dedup.shingle_set("É é A a", 1, hashes)) == 3  # only A-Z is lower-cased
    assert len(near_dedup.shingle_set("one", 5, hashes)) == 1 and len(near_dedup.shingle_set(" \t", 5, hashes)) == 0


def test_hard_rows(hard, nothing):
    rows = near_dedup.near_components(hard).collect()
    assert len(rows) == hard.count()
    by = {r["doc_id"]: r for r in rows}
    assert (by[1]["component_id"], by[2]["component_id"], by[2]["kept"]) == (1, 1, False)
    assert all(by[k]["n_shingles"] == 0 and by[k]["component_id"] == k and by[k]["kept"] for k in (3, 4, 5))
    assert by[None]["component_id"] is None and by[None]["kept"] and by[7]["kept"] and by[9]["n_shingles"] == 1
    kept = near_dedup.kept_documents(hard)
    assert kept.columns == hard.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 3, 4, 5, 6, 7, None, 9], key=str)
    assert near_dedup.near_components(nothing).count() == 0 and near_dedup.kept_documents(nothing).count() == 0


def test_deep_trees_keep_pairs_together():
    """The share of pairs at likeness 0.8 that no node of the deepest level of one tree holds; paths are followed while they are shared."""
    rng = np.random.default_rng(5)
    pairs = 1000
    least = rng.integers(0, 2**32, (pairs, near_dedup.TREES * near_dedup.COORDINATES), np.uint32)
    agree = rng.random(least.shape) < 0.8
    other = np.where(agree, least, ~least)
    of, node, used = np.arange(pairs), rng.integers(0, 2**63, pairs).astype(np.uint64), np.zeros(pairs, np.int64)
    for _ in range(14):
        tree = np.zeros(len(of), np.int64)
        both = zip(near_dedup.branch(node, used, tree, least[of]), near_dedup.branch(node, used, tree, other[of]))
        found = [(of[a == b], a[a == b], now[a == b]) for (a, now), (b, _) in both]
        of, node, used = (np.concatenate(x) for x in zip(*found))
        # Some shared nodes of a pair stand for the others.
        order = np.lexsort((node, of))
        of, node, used = of[order], node[order], used[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        of, node, used = of[place < 32], node[place < 32], used[place < 32]
    missed = 1 - len(np.unique(of)) / pairs
    assert missed ** near_dedup.TREES < 1e-3


def test_shared_shingles_are_counted_by_those_of_the_passing_set():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (1, 7, 40, 80, 80)]
    held = near_dedup.Shingles(sets)
    for found in [*sets, np.array([99], np.uint64), np.array([0, 59, 10**18], np.uint64)]:
        assert held.shared(found).tolist() == [len(np.intersect1d(found, s)) for s in sets]
        assert held.sizes.tolist() == [len(s) for s in sets]


@pytest.mark.parametrize("at_once", [near_dedup.AT_ONCE, 64])
def test_minwise_values_equal_those_of_one_function_at_a_time(monkeypatch, at_once):
    monkeypatch.setattr(near_dedup, "AT_ONCE", at_once)
    rng = np.random.default_rng(4)
    for n in (0, 1, 1023, 1024, 2500):
        shingles = rng.integers(0, 2**63, n).astype(np.uint64)
        found = near_dedup.minwise(shingles)
        for k in (0, 63, 64, 200, near_dedup.BITS - 1):
            least = 2**32 - 1
            for x in (shingles >> np.uint64(32)).tolist():
                y = (x ^ int(near_dedup._SEEDS[k])) * int(near_dedup._FACTORS[k]) % 2**32
                least = min(least, (y ^ y >> 15) * 0x2C1B3C6D % 2**32)
            assert found[k] == least


def test_a_task_has_one_python_worker(spark, capsys):
    """Workers that wait on one another in a task stay in memory for all later stages."""
    docs = spark.createDataFrame([(k, f"some words of text {k}") for k in range(20)] + [(None, "x"), (3, None)], "doc_id long, text string")
    ids = spark.createDataFrame([(3,), (5,), (19,), (77,)], "id long")
    sets = near_dedup._sets_of(ids, docs, 2)
    assert {r["id"] for r in sets.collect()} >= {3, 5, 19} and sets.filter("id = 3").count() == 2 and sets.count() < 10
    reps = near_dedup.sketches(docs.filter("doc_id is not null"), 2).selectExpr("doc_id as rep", "n_shingles as n", *near_dedup.SKETCH, "least")
    large = spark.sparkContext.broadcast((np.array([1]), np.array([2])))
    with_runs = near_dedup.first_paths(materialise(reps, "t"), large)
    for df in (sets, with_runs):
        df.explain()
        plan = capsys.readouterr().out.split("Initial Plan")[0]
        assert sum(plan.count(x) for x in ("MapInArrow", "ArrowEvalPython", "BatchEvalPython")) == 1


def test_large_nodes_get_their_runs(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "RUN", 4)
    docs = spark.createDataFrame([(k, "the same words in every text " + "again " * (k % 3)) for k in range(60)], "doc_id long, text string")
    reps = materialise(near_dedup.sketches(docs, 2).selectExpr("doc_id as rep", "n_shingles as n", *near_dedup.SKETCH, "least"), "t")
    dealt = near_dedup._with_runs(near_dedup.first_paths, reps)
    sizes = {}
    for r in dealt.select("node", "run").collect():
        sizes.setdefault(r["node"], []).append(r["run"])
    assert all(0 <= run < max(1, len(runs) // 4) for runs in sizes.values() for run in runs)
    assert all(len(set(runs)) > 1 for runs in sizes.values() if len(runs) >= 16)
    assert {(r["rep"], r["node"]) for r in dealt.collect()} == {(r["rep"], r["node"]) for r in near_dedup.first_paths(reps).collect()}
