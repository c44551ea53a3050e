"""Toxicity by a factorization machine over hashed terms.

A text's terms say how often its words and their first four to eight letters occur: once, twice, or three times and more.
They are hashed to ``2**HASH_BITS`` numbers.  The machine scores a text as

    bias + sum of w[i] + sum over pairs of <v[i], v[j]>

over its terms, so that pairs of terms count that say more together than each by itself.  Three steps:

1. A sample of at most ``MAX_ROWS`` training documents of each label is drawn, those with the smallest hash of their id.
   It is bounded whatever the size of the corpus, so its ids are broadcast and texts are never shuffled.
2. The sample's terms are counted in Spark.  Those of ``MIN_DOCS`` documents enter the model, whatever each of them tells by
   itself: a pair may tell what its terms do not.  The machine is fitted on the driver; weights that earn nothing go to zero.
3. All texts are scored in Arrow batches against the fitted weights (at most ``2**HASH_BITS`` x (``FACTORS`` + 1) numbers).

Label, language, source and id are no inputs of a score.

Defined results: a null text is empty and scored by the bias; a null label is no label, several labels of a document are
toxic if any is; without labels of both kinds every score is the share of toxic labels (0 without labels); repeated rows
get the same score; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesync.llm.common import fold_of, giving_back, materialise

HASH_BITS = 24
#: Documents of each label that the machine is fitted on.
MAX_ROWS = 20_000
#: A term enters the model from so many documents of the sample on.
MIN_DOCS = 4
#: Lengths of the word beginnings that are terms, and the counts that are told apart.
BEGINNINGS = (4, 5, 6, 7, 8)
LEVELS = (1, 2, 3)
FACTORS = 4
EPOCHS = 25
BATCH = 128
RATE, DECAY = 0.1, 1e-4
#: Where AdaGrad's sums of weights and of factors start, so that the many terms of a text do not overshoot together.
FIRST_W, FIRST_V = 1e-4, 0.3
#: Pull of weights to zero.
SPARSE = 2e-3
THRESHOLD = 0.7
HELD_OUT_PARTS, HELD_OUT = 3, 1
#: Words whose stems a task keeps.
KEPT = 200_000
#: Texts whose terms are found together.
TOGETHER = 128
#: Parts in which the sample's terms come to the driver.
PARTS = 16

_WORD = re.compile(r"[^\W\d_]+")
_MASK = (1 << HASH_BITS) - 1


#: What a level adds to the hash of a stem.
STEP = 0x9E3779


def term(stem: np.ndarray, level: int | np.ndarray) -> np.ndarray:
    return (stem + level * STEP) & _MASK


def bit_map(terms: np.ndarray) -> np.ndarray:
    """A bit for each of 2**HASH_BITS terms, set for the sorted ``terms``."""
    bits, words = np.zeros((_MASK + 1) >> 6, "<u8"), terms >> 6
    first = np.flatnonzero(np.diff(words, prepend=-1))
    if len(first):
        bits[words[first]] = np.bitwise_or.reduceat(np.uint64(1) << (terms & 63).astype(np.uint64), first)
    return bits


class Places:
    """The numbers of a sorted set of terms, found in a bit map of all terms and the counts before each of its words."""

    def __init__(self, terms: np.ndarray) -> None:
        self.bits = bit_map(terms)
        self.before = (np.cumsum(np.bitwise_count(self.bits), dtype=np.int32) - np.bitwise_count(self.bits)).astype(np.int32)

    def of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``terms`` are in the set, and the numbers of those."""
        word, bit = terms >> 6, np.uint64(1) << (terms & 63).astype(np.uint64)
        bits = self.bits[word]
        there = np.flatnonzero(bits & bit)
        return there, self.before[word[there]] + np.bitwise_count(bits[there] & (bit[there] - np.uint64(1)))


class Terms(dict):
    """Maps a word to a number and keeps the stems of what it has seen; with ``known`` terms, only stems of those."""

    def __init__(self, known: bytes | None = None) -> None:
        super().__init__()
        self.places = self.stems = None
        if known is not None:
            terms = np.frombuffer(known, "<i4")
            self.places = Places(terms)
            self.stems = bit_map(np.sort(np.concatenate([(terms.astype(np.int64) - level * STEP) & _MASK for level in LEVELS]))).tobytes()
        self.forget()

    def forget(self) -> None:
        """Drop all words; their stems stand one after the other, those of word k from ends[k] to ends[k + 1]."""
        self.clear()
        self.flat, self.ends = array("i"), array("q", [0])

    def __missing__(self, word: str) -> int:
        stems = [zlib.crc32(f"{word}$".encode()) & _MASK, *(zlib.crc32(word[:n].encode()) & _MASK for n in BEGINNINGS if len(word) >= n)]
        self.flat.extend(stems if self.stems is None else [x for x in stems if self.stems[x >> 3] >> (x & 7) & 1])
        self.ends.append(len(self.flat))
        found = self[word] = len(self)
        return found

    def of(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """The sorted terms of each text, one after the other, and where they start; their numbers in the model if there is one."""
        if len(self) >= KEPT:
            self.forget()
        words, times, sizes = array("q"), array("q"), []
        for text in texts:
            counts = Counter(_WORD.findall((text or "").lower()))
            words.extend(map(self.__getitem__, counts))
            times.extend(counts.values())
            sizes.append(len(counts))
        words, times, ends = np.asarray(words), np.asarray(times), np.asarray(self.ends)
        widths = ends[words + 1] - ends[words]
        until = np.cumsum(widths)
        total = int(until[-1]) if len(until) else 0
        stems = np.asarray(self.flat)[np.arange(total) + np.repeat(ends[words + 1] - until, widths)].astype(np.int64)
        row = np.repeat(np.repeat(np.arange(len(sizes)), sizes), widths)
        # Text, stem and count in one number, so that one sort brings a text's equal stems together.  More than the highest
        # level of one word counts as that level.
        few = np.minimum(np.repeat(times, widths), LEVELS[-1])
        packed = np.sort((row << HASH_BITS | stems) << 2 | few)
        keys = packed >> 2
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        count = np.add.reduceat(packed & 3, first) if len(first) else first
        keys, found = keys[first], []
        for level in LEVELS:  # few stems reach the higher ones
            there = np.flatnonzero(count >= level) if level > 1 else slice(None)
            rows, terms = keys[there] & ~_MASK, term(keys[there] & _MASK, level)
            if self.places is not None:
                here, terms = self.places.of(terms)
                rows, terms = rows[here], terms.astype(np.int64)
            found.append(rows | terms)
        keys = np.sort(np.concatenate(found))
        keys = keys[np.diff(keys, prepend=-1) != 0]  # levels of different stems may share a hash
        return (keys & _MASK).astype(np.int32), np.searchsorted(keys >> HASH_BITS, np.arange(len(sizes) + 1))


def terms_of(texts: list, terms: Terms) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Terms and starts, a few texts at a time."""
    for at in range(0, len(texts), TOGETHER):
        yield terms.of(texts[at: at + TOGETHER])


class Machine:
    """The fitted weights: bias, one weight and FACTORS factors for each model term."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray) -> None:
        self.bias, self.weights, self.factors = bias, weights, factors
        self._own = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_own": None}

    def margins(self, terms: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores before the logistic function; row r has the terms from starts[r] to starts[r + 1]."""
        if self._own is None:  # what a term adds by itself, and the factors beside it
            self._own = np.column_stack([self.weights - 0.5 * (self.factors ** 2).sum(1), self.factors])
        out = np.full(len(starts) - 1, self.bias)
        filled = np.flatnonzero(np.diff(starts))
        if len(filled):
            sums = np.add.reduceat(self._own[terms], starts[filled], axis=0)
            out[filled] += sums[:, 0] + 0.5 * (sums[:, 1:] ** 2).sum(1)
        return out

    def probabilities(self, terms: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(terms, starts), -40, 40)))

    def scores(self, rows: list) -> np.ndarray:
        starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        return self.probabilities(np.concatenate([np.zeros(0, np.int64), *(np.asarray(r, np.int64) for r in rows)]), starts)


def fit(rows: list, labels: np.ndarray, n_terms: int, seed: int = 7) -> Machine:
    """Logistic loss, AdaGrad in mini-batches; factors start near zero so that pairs have to earn their weight.

    After each step the weights are drawn towards zero, by SPARSE times their rate, so that terms that tell nothing by
    themselves get none; their factors stay free.
    """
    rng = np.random.default_rng(seed)
    model = Machine(0.0, np.zeros(n_terms), rng.normal(0, 0.02, (n_terms, FACTORS)))
    sum_b, sum_w, sum_v = 1e-6, np.full(n_terms, FIRST_W), np.full((n_terms, FACTORS), FIRST_V)
    rows = [np.asarray(r, np.int32) for r in rows]
    # Places are 64-bit numbers, as numpy's indexing and counting would otherwise convert them each time.
    sizes, number = np.array([len(r) for r in rows], np.int64), np.zeros(n_terms, np.intp)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            picked = order[k: k + BATCH]
            terms = np.concatenate([rows[i] for i in picked])
            used = np.sort(terms)
            used = used[np.diff(used, prepend=-1) != 0].astype(np.intp)
            number[used] = np.arange(len(used))
            where = number.take(terms)
            # The machine of the terms of this batch.
            part = Machine(model.bias, model.weights.take(used), model.factors.take(used, 0))
            filled, starts = np.flatnonzero(sizes[picked]), np.cumsum(sizes[picked]) - sizes[picked]
            starts = starts[filled]
            margins, sums = np.full(len(picked), part.bias), np.zeros((FACTORS, len(picked)))
            if len(filled):
                margins[filled] += np.add.reduceat((part.weights - 0.5 * (part.factors ** 2).sum(1)).take(where), starts)
                for f in range(FACTORS):
                    sums[f, filled] = np.add.reduceat(part.factors[:, f].copy().take(where), starts)
                margins += 0.5 * (sums ** 2).sum(0)
            wrong = (1 / (1 + np.exp(-np.clip(margins, -40, 40))) - labels[picked]) / len(picked)
            sum_b += wrong.sum() ** 2
            model.bias -= RATE * wrong.sum() / np.sqrt(sum_b)
            if not len(terms):
                continue
            pull = lambda by: np.bincount(where, np.repeat(by, sizes[picked]), len(used))
            grad_w = pull(wrong)
            grad_v = np.stack([pull(wrong * sums[f]) for f in range(FACTORS)], 1) + (DECAY - grad_w[:, None]) * part.factors
            grad_w += DECAY * part.weights
            now_w, now_v = sum_w.take(used) + grad_w ** 2, sum_v.take(used, 0) + grad_v ** 2
            sum_w[used], sum_v[used] = now_w, now_v
            rate = RATE / np.sqrt(now_w)
            moved = part.weights - rate * grad_w
            model.weights[used] = np.sign(moved) * np.maximum(np.abs(moved) - SPARSE * rate, 0)
            model.factors[used] = part.factors - RATE * grad_v / np.sqrt(now_v)
    return model


def choose_terms(sample: DataFrame) -> bytes:
    """The model terms, sorted, as numbers of 32 bits: all that occur in MIN_DOCS documents of the sample."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            for found, _ in terms_of(batch.column("text").to_pylist(), terms):
                found, n = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], ["term", "n"])

    counts = sample.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    chosen = counts.filter(F.col("n") >= MIN_DOCS).select("term").toArrow().column("term").to_numpy()
    return np.sort(chosen).astype("<i4").tobytes()


def model_terms(sample: DataFrame, known: bytes) -> DataFrame:
    """The numbers of each text's model terms, in place of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(known)
        for batch in batches:
            at = 0
            for found, starts in terms_of(batch.column("text").to_pylist(), terms):
                some, at = batch.slice(at, len(starts) - 1), at + len(starts) - 1
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(found))
                yield pa.RecordBatch.from_arrays([some.column(c) for c in ("doc_id", "hash", "toxic")] + [lists], ["doc_id", "hash", "toxic", "terms"])

    return sample.mapInArrow(run, f"doc_id {dict(sample.dtypes)['doc_id']}, hash long, toxic int, terms array<int>")


def collected(found: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """The terms of each row and the labels, in the order of ids and texts; a part at a time, so that little stands twice."""
    ids, hashes, labels, rows = [], [], [], []
    for k in range(PARTS):
        part = found.filter(F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)) == k).toArrow().combine_chunks()
        if len(part):
            lists = part.column("terms").combine_chunks()
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy().copy()
            ids += part.column("doc_id").to_pylist()
            hashes.append(part.column("hash").to_numpy())
            labels.append(part.column("toxic").to_numpy())
            rows += [values[a:b] for a, b in zip(at, at[1:])]
        del part
    hashes = np.concatenate([np.zeros(0, np.int64), *hashes])
    order = sorted(range(len(rows)), key=lambda i: (ids[i], hashes[i]))
    return [rows[i] for i in order], np.concatenate([np.zeros(0), *labels]).astype(float)[order]


def train(docs: DataFrame, labels: DataFrame) -> tuple[Machine, bytes]:
    """Learn from the labelled documents outside the held-out fold."""
    marks = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic")).filter(
        "__id is not null and toxic in (0, 1)")
    marks = marks.filter(fold_of("__id", HELD_OUT_PARTS) != HELD_OUT).groupBy("__id").agg(F.max("toxic").alias("toxic"))
    marks = materialise(marks, "toxicity-labels")
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not clean:
        share = toxic / max(1, toxic + clean)
        return Machine(float(np.log(max(share, 1e-17) / max(1 - share, 1e-17))), np.zeros(0), np.zeros((0, FACTORS))), b""
    drawn = [marks.filter(F.col("toxic") == k).orderBy(F.xxhash64("__id"), "__id").limit(MAX_ROWS) for k in (0, 1)]
    drawn = materialise(drawn[0].union(drawn[1]), "toxicity-sample")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sample = texts.join(F.broadcast(drawn), F.col("doc_id") == F.col("__id"))  # 2 x MAX_ROWS ids
    sample = sample.select("doc_id", F.xxhash64("text").alias("hash"), "text", "toxic")
    terms = choose_terms(sample)
    rows, marked = collected(materialise(model_terms(sample, terms), "toxicity-terms"))
    machine = fit(rows, marked, len(terms) // 4)
    del rows
    pa.default_memory_pool().release_unused()
    # The sample holds the labels in other shares than the corpus; the bias takes that back.
    machine.bias += float(np.log(toxic / clean) - np.log(min(toxic, MAX_ROWS) / min(clean, MAX_ROWS)))
    return machine, terms


def score(text: Column, machine: Machine, terms: bytes) -> Column:
    """The probability of the label, 0 to 1."""
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lookup = Terms(terms)
        for texts in giving_back(batches):
            yield pd.Series(np.concatenate([np.zeros(0), *(machine.probabilities(*found) for found in terms_of(texts.to_list(), lookup))]))

    return run(text.cast("string"))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    machine, terms = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.select("doc_id", (fold_of("doc_id", HELD_OUT_PARTS) == HELD_OUT).alias("held_out"), score(F.col("text"), machine, terms).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, unchanged."""
    machine, terms = train(docs, labels)
    return docs.filter(score(F.col("text"), machine, terms) < THRESHOLD)
