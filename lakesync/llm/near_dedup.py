"""Near-duplicate documents by a chosen-path set similarity join.

Every distinct shingle set is a vertex, so exact copies cost nothing.  A set's path in a random tree is chosen by minwise
tokens: a node picks ``BRANCHES`` of the tree's ``COORDINATES`` minwise hash functions by its own name, and sends each set to
one child per function, named after the set's minwise value there.  A pair of likeness s stays together in a child with
chance s.  With fresh functions everywhere a tree would keep it together with chance p = 1 - (1 - s p)^2, which is 0.9375 for
s = 0.8.  A path never uses a function twice and subtrees share some of the tree's functions, so depth costs a little: a
simulation of ``branch`` at s = 0.8 (8,000 pairs) gives for all ``TREES`` trees a miss of 0.9 in 100,000 at level 2, 2.3 at
level 5 and 2.9 at level 14, the deepest; nearer pairs are missed far less.

Nodes of up to ``NODE`` sets are compared exhaustively, on 512 one-bit minwise hashes.  In larger nodes each set is compared
with ``NODE`` others first, so that a group of any number of copies becomes one component.  Then, if at most ``NODE`` sets of
a node are outside its largest component, those are compared with all others, which settles the node; else it is branched
again.  Once that comparison costs no more than ``LOOKS`` looks at each set of the corpus for all nodes together, all are
settled.  Nodes with the same largest component are settled as one where that costs less, since a family fills many nodes
with the same sets.  What the sketches let pass is confirmed on the full shingle sets.

Data flow: texts are read where they lie and never shuffled as a whole.  Paths are narrow rows; the sets that pairs are
confirmed on are computed for the rows of a bounded bit map only.

Defined results: a null text has no shingles; very long texts are taken whole; of equally likely partners the one with the
smaller place in its node's order is confirmed first, which changes no component; a document without shingles is linked with nothing; rows that share an id are
one document, linked by whatever any of them is linked by; rows without an id get no component and are kept; an empty table
gives an empty table; other columns, whatever their names, are not looked at, and come back unchanged from ``kept_documents``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesync.llm.common import free_names, giving_back, materialise, text_or_empty
from lakesync.llm.links import components

#: Words of a shingle and percentage of likeness, unless a caller says otherwise.
WORDS, PERCENT = 5, 80
#: A tree has several times as many functions as levels, so that its subtrees hardly share any and paths do not run out.
TREES, COORDINATES, BRANCHES, FIRST_DEPTH, DEEPEST = 4, 48, 2, 2, 14
#: Sets that are compared with each other at most, in a node.
NODE = 64
LOOKS = 256
#: Rows of a run that a node of twice as many is cut into.
RUN = 1024
#: Sets that a task holds while the other sets of their node pass by.
BLOCK = 256
#: Bits of a sketch, and how many of them must agree: 461 do at a likeness of 0.8, with a deviation of 6.8.
BITS, MIN_AGREEING = 512, 426
SKETCH = [f"b{k}" for k in range(BITS // 64)]
#: Large nodes up to this number (16 bytes each) are made known to every task; more are joined.
BROADCAST_ROWS = 200_000
#: Size of the bit map of ids whose sets are computed for confirmation.
MAP_BITS = 1 << 25
#: Words whose hashes a task keeps.
KEPT = 200_000
#: Hash functions that are applied to a text's shingles together; a divisor of BITS.
AT_ONCE = 128
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit numbers (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


_SEEDS, _FACTORS = (mixed(np.arange(1, BITS + 1, dtype=np.uint64) * m).astype(np.uint32) | np.uint32(1) for m in (_M1, _M2))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def shingle_set(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles; bytes.lower and bytes.split know A-Z and the six spaces only."""
    split = (text or "").encode().lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, split), np.uint64, len(split))
    size = min(words, len(each))
    found = each[: len(each) - size + 1].copy()
    for j in range(1, size):
        found = mixed(found * _M1 + each[j: len(each) - size + 1 + j])
    return np.unique(mixed(found + np.uint64(size)))


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The BITS minwise values of a set, of 32 bits each."""
    least = np.full(BITS, np.iinfo(np.uint32).max, np.uint32)
    if not len(shingles):
        return least
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    # A few hash functions and shingles at a time, in two tables that are used again and again.
    placed, moved = np.empty((2, AT_ONCE, min(len(high), 1024)), np.uint32)
    for at in range(0, len(high), 1024):
        part = high[None, at: at + 1024]
        x, y = placed[:, : part.shape[1]], moved[:, : part.shape[1]]
        for k in range(0, BITS, AT_ONCE):
            np.bitwise_xor(part, _SEEDS[k: k + AT_ONCE, None], out=x)
            np.multiply(x, _FACTORS[k: k + AT_ONCE, None], out=x)
            np.right_shift(x, np.uint32(15), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint32(0x2C1B3C6D), out=x)
            np.minimum(least[k: k + AT_ONCE], x.min(1), out=least[k: k + AT_ONCE])
    return least


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, two hashes of the set, longs of sketch bits, and the minwise values that trees choose from."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in giving_back(batches):
            sizes, bits, values, names = [], [], [], []
            for text in batch.column("text"):
                found = shingle_set(text.as_py(), words, hashes)
                least = minwise(found)
                raw = found.tobytes()
                sizes.append(len(found))
                names.append((xxhash.xxh3_64_intdigest(raw), xxhash.xxh64_intdigest(raw)))
                bits.append(np.packbits((mixed(least.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).view(np.int64))
                values.append(least[: TREES * COORDINATES].astype("<u4").tobytes())
            names = np.array(names, np.uint64).reshape(-1, 2).view(np.int64)
            bits = np.array(bits, np.int64).reshape(-1, len(SKETCH))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(names[:, 0]), pa.array(names[:, 1]),
                 pa.array(values, pa.binary()), *(pa.array(bits[:, k].copy()) for k in range(len(SKETCH)))],
                ["doc_id", "n_shingles", "h1", "h2", "least", *SKETCH])

    schema = "doc_id long, n_shingles long, h1 long, h2 long, least binary, " + ", ".join(f"{b} long" for b in SKETCH)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def branch(node: np.ndarray, used: np.ndarray, tree: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The children of rows in nodes: (node, used) for each of the functions that the node chooses among its unused ones."""
    rows = np.arange(len(node))
    wish = mixed(node[:, None] * _M1 + np.arange(COORDINATES, dtype=np.uint64))
    taken = (used[:, None] >> np.arange(COORDINATES)) & 1
    wish[taken.astype(bool)] = np.iinfo(np.uint64).max
    chosen = np.argpartition(wish, BRANCHES - 1, axis=1)[:, :BRANCHES]
    for k in range(BRANCHES):
        c = chosen[:, k]
        value = least[rows, tree * COORDINATES + c].astype(np.uint64)
        yield mixed(mixed(node + (c.astype(np.uint64) + np.uint64(1)) * _M1) ^ value), used | (1 << c)


_SET = ["rep", "n", *SKETCH]
_PATH = "node long, state long, run long, " + ", ".join(f"{c} long" for c in _SET)


def _rows_of(node, used, tree, columns, large) -> pa.RecordBatch:
    state, run, node = tree.astype(np.int64) << COORDINATES | used, np.zeros(len(node), np.int64), node.view(np.int64)
    if large is not None:
        names, runs = large.value
        at = np.minimum(np.searchsorted(names, node), len(names) - 1)
        dealt = mixed(columns[0].to_numpy().astype(np.int64).view(np.uint64) * _M1) % runs[at].astype(np.uint64)
        run = np.where(names[at] == node, dealt.astype(np.int64), 0)
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(state), pa.array(run), *columns], ["node", "state", "run", *_SET])


def first_paths(reps: DataFrame, large: Broadcast | None = None) -> DataFrame:
    """The nodes of every set after the first levels of all trees; with the runs of ``large`` nodes, if any, else run 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            least = np.frombuffer(b"".join(batch.column("least").to_pylist()), "<u4").reshape(len(batch), -1)
            columns = [batch.column(c) for c in _SET]
            for t in range(TREES):
                tree = np.full(len(batch), t)
                level = [(np.full(len(batch), mixed(np.array([t + 1], np.uint64))[0]), np.zeros(len(batch), np.int64))]
                for _ in range(FIRST_DEPTH):
                    level = [child for node, used in level for child in branch(node, used, tree, least)]
                for node, used in level:
                    yield _rows_of(node, used, tree, columns, large)

    return reps.select(*_SET, "least").mapInArrow(run, _PATH)


def next_paths(rows: DataFrame, large: Broadcast | None = None) -> DataFrame:
    """The children of rows (a path and its set's minwise values), with runs as above."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            least = np.frombuffer(b"".join(batch.column("least").to_pylist()), "<u4").reshape(len(batch), -1)
            node = batch.column("node").to_numpy().view(np.uint64)
            state = batch.column("state").to_numpy().astype(np.int64)
            tree, used = state >> COORDINATES, state & ((1 << COORDINATES) - 1)
            for child, now in branch(node, used, tree, least):
                yield _rows_of(child, now, tree, [batch.column(c) for c in _SET], large)

    return rows.select("node", "state", *_SET, "least").mapInArrow(run, _PATH)


def _with_runs(paths_of: Callable, rows: DataFrame) -> DataFrame:
    """Paths with ``run``: large nodes are cut into runs by hash; every run is large enough to tell that its node is.

    The runs are given out by the function that makes the paths: one by one after it would keep a second Python worker a task.
    """
    paths = paths_of(rows)
    sizes = paths.groupBy("node").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") >= 2 * RUN)
    sizes = materialise(sizes.select("node", F.floor(F.col("rows") / RUN).cast("long").alias("runs")), "near-sizes")
    known = sizes.count()
    if not known:
        return paths
    if known > BROADCAST_ROWS:
        run = F.coalesce(F.pmod(F.xxhash64("rep"), F.col("runs")), F.lit(0).cast("long"))
        return paths.drop("run").join(sizes, "node", "left").withColumn("run", run)
    table = sizes.orderBy("node").toArrow()
    return paths_of(rows, rows.sparkSession.sparkContext.broadcast((table["node"].to_numpy(), table["runs"].to_numpy())))


def compare_nodes(paths_of: Callable, rows: DataFrame, percent: int) -> DataFrame:
    """Compare the sets of each node of the paths that ``paths_of`` makes of ``rows``; rows (kind, a, b, node, state).

    kind 0: a likely pair, the likeliest earlier partner of ``b``; kind 1: another likely pair of a small node; kind 2: ``a`` belongs to a
    node of more than NODE sets.  Rows arrive sorted by node, run and set.  Each is compared with the NODE rows before it in its run, so
    a task holds a batch and NODE more rows at a time, however large the node is.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in filter(len, batches):
            new = [batch.column(c).to_numpy() for c in ("node", "state", "run", *_SET)]
            old = 0 if kept is None else len(kept[0])
            now = new if kept is None else [np.concatenate(x) for x in zip(kept, new)]
            node, state, part, rep, n, *bits = now
            left, right, unlike, back = [], [], [], []
            for k in range(1, min(NODE, len(node) - 1) + 1):
                # The row k places ahead, for those that are new in this batch.
                low = max(old - k, 0)
                i = np.flatnonzero((node[low: len(node) - k] == node[low + k:]) & (part[low: len(node) - k] == part[low + k:])) + low
                if not len(i):
                    break
                back.append(i + k if k == NODE else i[:0])
                small, large = np.minimum(n[i], n[i + k]), np.maximum(n[i], n[i + k])
                i = i[(small * 100 >= large * percent) & (rep[i] != rep[i + k])]
                differing = sum(np.bitwise_count((b[i] ^ b[i + k]).view(np.uint64)).astype(int) for b in bits)
                likely = BITS - differing >= MIN_AGREEING
                left.append(i[likely])
                right.append(i[likely] + k)
                unlike.append(differing[likely])
            i, j, unlike = (np.concatenate(x) if x else np.zeros(0, int) for x in (left, right, unlike))
            order = np.lexsort((i, unlike, j))
            i, j = i[order], j[order]
            kind = np.concatenate([[0], (j[1:] == j[:-1]).astype(int)])[: len(j)]
            beyond = np.concatenate(back) if back else np.zeros(0, int)
            # The first NODE rows of a large node are known to be in one when its next row comes.
            starts = beyond[(node[beyond - NODE - 1] != node[beyond]) | (part[beyond - NODE - 1] != part[beyond])] if len(beyond) else beyond
            starts = np.union1d(starts, beyond[beyond == NODE]) if len(beyond) else beyond
            large = np.unique(np.concatenate([beyond, *(starts - m for m in range(1, NODE + 1))])) if len(beyond) else beyond
            # Large nodes are settled or branched later, so one likely partner of each of their sets is enough here.
            needed = (kind == 0) | ~np.isin(j, large)
            i, j, kind = i[needed], j[needed], kind[needed]
            none = np.zeros(len(i), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([kind, np.full(len(large), 2)]).astype(np.int32)), pa.array(np.concatenate([rep[i], rep[large]])),
                 pa.array(np.concatenate([rep[j], rep[large]])), pa.array(np.concatenate([none, node[large]])),
                 pa.array(np.concatenate([none, state[large]]))], ["kind", "a", "b", "node", "state"])
            kept = [x[-(NODE + 1):] for x in now]

    dealt = _with_runs(paths_of, rows).repartition("node", "run").sortWithinPartitions("node", "run", "rep").select("node", "state", "run", *_SET)
    return dealt.mapInArrow(run, "kind int, a long, b long, node long, state long")


def _bit_map(ids: DataFrame) -> DataFrame:
    """The words that are not 0 of a bit map of hashed ids, of fixed size: it only spares work, so a full one does no harm."""
    at = F.pmod(F.xxhash64("id"), F.lit(MAP_BITS))
    words = ids.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits"))
    return materialise(words, "near-marks")


def _sets_of(ids: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(id, shingles) of the documents with these ids, and of a few others: texts are read where they lie.

    Spark looks the bits up itself, so that a task has one Python worker, not one for the bits and one for the sets.
    """
    marked = F.broadcast(_bit_map(ids.distinct()))  # MAP_BITS / 64 rows at most

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in giving_back(batches):
            found = [shingle_set(t.as_py(), words, hashes).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], ["id", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).filter("id is not null")
    texts = texts.withColumn("at", F.pmod(F.xxhash64("id"), F.lit(MAP_BITS))).join(marked, F.shiftright("at", 6) == F.col("word"))
    texts = texts.filter("(shiftright(bits, cast(at % 64 as int)) & 1L) = 1").select("id", "text")
    return texts.mapInArrow(sets, "id long, shingles binary")


def confirm(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the likeness."""
    pairs = materialise(pairs.select("a", "b").distinct(), "near-pairs")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = _sets_of(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))), docs, words)
    both = pairs.join(of.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(
        of.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return materialise(both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long").distinct(), "near-links")


def _between(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components so far, with those components."""
    named = pairs.join(of.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(
        of.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
    named = named.withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")})
    return named.filter("ca <> cb")


def _merged(of: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links."""
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    known = of.join(ends, "id", "full").select("id", F.coalesce("component", "id").alias("component"))
    known = materialise(known, "near-known")
    edges = _between(links, known).select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))
    joined = components(edges)
    return materialise(known.join(joined.select(F.col("id").alias("component"), F.col("component").alias("new")), "component", "left").select(
        "id", F.coalesce("new", "component").alias("component")), "near-components")


def near_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable) and kept, for each row of ``docs``."""
    every = materialise(sketches(docs, words), "near-sketches")
    filled = every.filter("n_shingles > 0 and doc_id is not null")
    copies = filled.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    members = filled.join(copies, ["h1", "h2"])
    reps = materialise(members.filter("doc_id = rep").select("rep", F.col("n_shingles").alias("n"), *SKETCH, "least").dropDuplicates(
        _SET), "near-sets")

    sets = reps.count()
    found = materialise(compare_nodes(first_paths, reps, percent), "near-compared")
    pairs = found.filter("kind < 2").groupBy("a", "b").agg(F.min("kind").alias("kind"))
    checked = pairs.filter("kind = 0").select("a", "b")
    of = materialise(components(confirm(checked, docs, words, percent)), "near-components")
    rest, depth = pairs.filter("kind = 1"), FIRST_DEPTH
    while True:
        fresh = rest.select("a", "b").distinct().join(checked, ["a", "b"], "left_anti")
        rest = materialise(_between(fresh, of).select("a", "b"), "near-rest")
        if not rest.isEmpty():
            of = _merged(of, confirm(rest, docs, words, percent))
            checked = checked.union(rest)
        large = found.filter("kind = 2").select("node", "state", F.col("a").alias("rep")).distinct()
        named = large.join(of.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        shares = named.groupBy("node", "component").agg(F.count(F.lit(1)).alias("rows"))
        nodes = shares.groupBy("node").agg(F.sum("rows").alias("rows"), F.max("rows").alias("most"), F.max_by("component", "rows").alias("main"))
        nodes = nodes.filter("rows > most").select("node", "main", "rows", (F.col("rows") - F.col("most")).alias("others"))
        nodes = materialise(nodes, "near-nodes")
        rows = materialise(named.join(nodes, "node"), "near-large")
        if rows.isEmpty():
            break
        depth += 1
        groups = materialise(_together(rows), "near-groups")
        looks = groups.agg(F.sum(F.least("looks", "looks_together"))).first()[0] or 0
        last = depth > min(DEEPEST, COORDINATES - BRANCHES) or looks <= LOOKS * sets
        if last:
            of = _merged(of, _settled(_regrouped(rows, groups), docs, words, percent))
            break
        few = rows.filter(F.col("others") <= NODE)
        of = _merged(of, _settled(_regrouped(few, _together(few)), docs, words, percent))
        deeper = rows.filter(F.col("others") > NODE).select("node", "state", "rep").join(reps, "rep")
        found = materialise(compare_nodes(next_paths, deeper, percent), "near-compared")
        rest = found.filter("kind < 2")
    reached = members.select("doc_id", "n_shingles", "rep").join(of.select(F.col("id").alias("rep"), "component"), "rep", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone = every.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return reached.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _together(rows: DataFrame) -> DataFrame:
    """For each main component: what its nodes cost one by one, what they cost as one, and how many others that one has."""
    alone = rows.select("node", "main", (F.col("rows").cast("double") * F.col("others")).alias("looks")).distinct()
    alone = alone.groupBy("main").agg(F.sum("looks").alias("looks"))
    merged = rows.select("main", "rep", "component").distinct().groupBy("main").agg(
        F.count(F.lit(1)).cast("double").alias("rows"), F.count_if(F.col("component") != F.col("main")).alias("others_together"))
    return alone.join(merged, "main").select("main", "looks", (F.col("rows") * F.col("others_together")).alias("looks_together"), "others_together")


def _regrouped(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of nodes, those with one main component as one node where that costs no more; all pairs of a node stay in one."""
    as_one = F.col("looks_together") <= F.col("looks")
    return rows.join(groups, "main").select(
        as_one.alias("as_one"), F.when(as_one, F.col("main")).otherwise(F.col("node")).alias("node"), "rep", "component", "main",
        F.when(as_one, F.col("others_together")).otherwise(F.col("others")).alias("others")).distinct()


class Shingles:
    """Sets by their shingles, to count what another set shares with each of them by looking up its own shingles only."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets])
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        self.owners = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.names, first = np.unique(every[order], return_index=True)
        self.ends = np.append(first, len(every))

    def shared(self, found: np.ndarray) -> np.ndarray:
        """How many of the distinct shingles ``found`` each set has."""
        at = np.minimum(np.searchsorted(self.names, found), len(self.names) - 1)
        at = at[self.names[at] == found]
        widths = self.ends[at + 1] - self.ends[at]
        until = np.cumsum(widths)
        places = np.arange(int(widths.sum())) + np.repeat(self.ends[at + 1] - until, widths)
        return np.bincount(self.owners[places], minlength=len(self.sizes))


def _settled(rows: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The links (a, b) in nodes between sets outside the largest component and sets of other components.

    ``rows``: as_one and node (the key of a node), rep, component, the main component and the number of others.  These come first, in
    blocks of ``BLOCK`` at most, and stay in memory while all sets of the node pass by and are compared on full sets.  So a
    set travels once per node and block, no pair is a row, and only links come out.
    """
    rows = rows.select("as_one", "node", "rep", "component", "main", F.ceil(F.col("others") / BLOCK).cast("int").alias("blocks"))
    sets = _sets_of(rows.select(F.col("rep").alias("id")), docs, words).select(F.col("id").alias("rep"), "shingles")
    held = rows.filter("component <> main").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("side", F.lit(0))
    passing = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(1))
    columns = ["as_one", "node", "block", "side", "rep", "component"]
    dealt = held.select(*columns).union(passing.select(*columns)).join(sets, "rep").select(*columns, "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, reps, comps, parts, ready = None, [], [], [], None
        for batch in batches:
            a, b = [], []
            for as_one, node, block, side, rep, comp, raw in zip(*(batch.column(c).to_pylist() for c in (*columns, "shingles"))):
                if (as_one, node, block) != at:
                    at, reps, comps, parts, ready = (as_one, node, block), [], [], [], None
                found = np.frombuffer(raw, np.uint64)
                if not len(found):  # another row of the id; it is linked with nothing
                    continue
                if side == 0:
                    reps.append(rep)
                    comps.append(comp)
                    parts.append(found)
                    continue
                if ready is None and parts:
                    ready = (Shingles(parts), np.array(reps), np.array(comps))
                if ready is None:
                    continue
                every, ids, own = ready
                common, sizes = every.shared(found), every.sizes
                near = (100 * common >= percent * (sizes + len(found) - common)) & (own != comp)
                a += np.minimum(ids[near], rep).tolist()
                b += np.maximum(ids[near], rep).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    ordered = dealt.repartition("as_one", "node", "block").sortWithinPartitions("as_one", "node", "block", "side", "rep")
    return materialise(ordered.mapInArrow(run, "a long, b long").distinct(), "near-links")


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2)


def kept_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents of which no smaller id is a near duplicate, with the columns of ``docs``; rows of one id and text once."""
    gone_id, same_text, times, of_id, of_text = free_names(docs, "__gone", "__text", "__times", "__id", "__same")
    gone = near_components(docs, words, percent).filter("not kept").select(F.col("doc_id").alias(gone_id)).distinct()
    kept = docs.join(gone, F.col("doc_id").cast("long") == F.col(gone_id), "left_anti").withColumn(same_text, F.xxhash64(text_or_empty()))
    repeats = materialise(
        docs.groupBy(F.col("doc_id").alias(of_id), F.xxhash64(text_or_empty()).alias(of_text)).agg(F.count(F.lit(1)).alias(times))
        .filter(F.col(times) > 1).drop(times), "repeated-rows")
    if repeats.isEmpty():
        return kept.drop(same_text)
    # Rows that stand once, nearly all of them, are not shuffled for it.
    same = F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.col(same_text) == F.col(of_text))
    first = kept.join(repeats, same, "left_semi").dropDuplicates(["doc_id", same_text])
    return kept.join(repeats, same, "left_anti").unionByName(first).drop(same_text)
