"""Code length of documents by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts: for every context of ``ORDER`` bytes, how often each byte followed in the training
documents, and for every shorter context, after how many contexts of one byte more it did (update exclusion).  A byte is coded
in its longest context; a context that has not seen the byte pays an escape, estimated from the number of different bytes it
has seen (method D: half a count of each goes to the escape), and hands over to the next shorter context without the symbols
that the longer ones have excluded.  Below the empty context all symbols left are equally likely.  A text is lower-cased (A-Z), starts
from a context of start marks and ends with an end mark; its score is the sum of the log10 probabilities.

The probability of a byte depends on its last ``ORDER + 1`` bytes only (a gram), so the trie is a set of tables by gram:

1. One pass over the training documents counts grams and words per task; Spark adds the counts up.  Shorter contexts are
   counted from the next longer ones.  The tables grow with the corpus and stay distributed.
2. The most frequent grams and words, at most ``FREQUENT`` of each, are broadcast in hash tables of fixed size.
3. One pass over all documents sums up what these cover.  Every other gram or word of a document leaves as a row and is
   joined with the full tables; grams that training never saw go down the orders, one join each, escape by escape.

The unigram base is computed in the same passes.

Defined results: a null text is empty and has only the end; without training documents all bytes are equally likely;
repeated rows are scored each; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesync.llm.common import cut_by_bytes, fold_of, materialise

#: Bytes of the longest context.
ORDER = 5
#: Grams, and words, that are broadcast at most, and the slots of their hash tables (2**SLOT_BITS).
FREQUENT, SLOT_BITS = 1 << 19, 21
#: Start mark and end mark: bytes that no UTF-8 text contains.
START, END = b"\xfe", b"\xff"
SYMBOLS = 256
HELD_OUT_PARTS, HELD_OUT = 7, 2
#: Bytes that are handled at once, rows of counts and word hashes that a task keeps at most.
PIECE, ROWS, KEPT = 1 << 20, 1 << 20, 200_000
#: The key of the end token among the words: the hash of a text that is no word.
END_WORD = int(np.uint64(xxhash.xxh64_intdigest(b" ")).astype(np.int64))
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def word_keys(text: bytes, hashes: WordHashes) -> np.ndarray:
    """The hashes of a lower-cased text's words; bytes.split knows just the six spaces."""
    words = text.split()
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)).view(np.int64)


def pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams of a batch of texts, in runs of bounded size: (gram of each position, number of its text)."""
    run, size = [], 0
    for at, text in enumerate(texts):
        marked = START * ORDER + text + END
        for k in range(ORDER, len(marked), PIECE):
            run.append((at, marked[k - ORDER: k + PIECE]))
            size += len(run[-1][1])
            if size >= PIECE:
                yield _grams(run)
                run, size = [], 0
    if run:
        yield _grams(run)


def _grams(run: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(p for _, p in run), np.uint8).astype(np.int64)
    sizes = np.array([len(p) for _, p in run])
    gram = data[ORDER:].copy()
    for j in range(1, ORDER + 1):
        gram |= data[ORDER - j: len(data) - j] << (8 * j)
    own = np.ones(len(data), bool)
    own[(np.cumsum(sizes) - sizes)[:, None] + np.arange(ORDER)] = False  # the context before a piece
    return gram[own[ORDER:]], np.repeat([at for at, _ in run], sizes - ORDER)


def _added(old: tuple[np.ndarray, np.ndarray] | None, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, counts = np.unique(keys, return_counts=True)
    if old is None:
        return found, counts
    every = np.concatenate([old[0], found])
    order = np.argsort(every, kind="stable")
    every, both = every[order], np.concatenate([old[1], counts])[order]
    starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[starts], np.add.reduceat(both, starts)


def counts(training: DataFrame) -> DataFrame:
    """(kind, key, n): kind 0 grams, kind 1 words with the end token, over all training documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, hashes = [None, None], WordHashes()

        def rows(kind: int) -> pa.RecordBatch:
            keys, n = tables[kind]
            tables[kind] = None
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n.astype(np.int64))], ["kind", "key", "n"])

        for batch in (part for whole in batches for part in cut_by_bytes(whole, "text")):
            texts = [(t.as_py() or "").encode().lower() for t in batch.column("text")]
            for grams, _ in pieces(texts):
                tables[0] = _added(tables[0], grams)
            for at in range(0, len(texts), 1000):
                part = texts[at: at + 1000]
                tables[1] = _added(tables[1], np.concatenate([*(word_keys(t, hashes) for t in part), np.full(len(part), END_WORD)]))
            for kind in (0, 1):
                if len(tables[kind][0]) > ROWS:
                    yield rows(kind)
        for kind in (0, 1):
            if tables[kind] is not None:
                yield rows(kind)

    return training.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


class HashTable:
    """Keys to values in 2**bits slots; a key is in one of its two slots or not kept."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int) -> None:
        self.bits = bits
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, values.dtype)
        for factor in (_K1, _K2):
            slots = self.slots(keys, factor)
            free = np.flatnonzero(self.keys[slots] == -1)
            put = free[np.unique(slots[free], return_index=True)[1]]
            self.keys[slots[put]], self.values[slots[put]] = keys[put], values[put]
            keys, values = np.delete(keys, put), np.delete(values, put)

    def slots(self, keys: np.ndarray, factor: np.uint64) -> np.ndarray:
        return ((keys.view(np.uint64) * factor) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values (0 where a key is not kept) and which keys are kept."""
        slot = self.slots(keys, _K1)
        kept = self.keys[slot] == keys
        out = np.where(kept, self.values[slot], 0)
        rest = np.flatnonzero(~kept)
        if len(rest):
            slot = self.slots(keys[rest], _K2)
            also = self.keys[slot] == keys[rest]
            out[rest] = np.where(also, self.values[slot], 0)
            kept[rest] = also
        return out, kept


def frequent(table: DataFrame, count: str, value: str, most: int = FREQUENT, bits: int = SLOT_BITS) -> HashTable:
    """The hash table of the most frequent keys: whole classes of counts, from the top, as long as they fit."""
    level = F.floor(F.log2(F.col(count)) * 8).cast("int")  # at most 8 x 63 classes
    sizes = {r["level"]: r["n"] for r in table.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, total = None, 0
    for at in sorted(sizes, reverse=True):
        total += sizes[at]
        if total > most:
            break
        least = at
    if least is None:
        return HashTable(np.zeros(0, np.int64), np.zeros(0), bits)
    rows = table.filter(level >= least).select("key", value).toArrow()
    return HashTable(rows.column("key").to_numpy(), rows.column(value).to_numpy(), bits)


def _shorter(key: str, order: int) -> Column:
    """The gram (or context) cut to its last ``order + 1`` bytes."""
    return F.col(key).bitwiseAND(F.lit((1 << (8 * (order + 1))) - 1))


class Trie:
    """Tables by order: ``grams[k]`` (key, n) and ``stats[k]`` (context, total, kinds), for contexts of k bytes."""

    def __init__(self, grams: DataFrame) -> None:
        self.grams, self.stats = {ORDER: grams}, {}
        for k in range(ORDER - 1, -1, -1):
            self.grams[k] = materialise(self.grams[k + 1].select(_shorter("key", k).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")), "ppm-grams")
        for k, table in self.grams.items():
            self.stats[k] = table.groupBy(F.shiftright("key", 8).alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))

    def seen(self) -> DataFrame:
        """(key, n, logp) of all grams of training: the longest context knows the byte."""
        table = self.grams[ORDER].withColumn("context", F.shiftright("key", 8)).join(self.stats[ORDER], "context")
        return table.select("key", "n", F.log10((F.col("n") - 0.5) / F.col("total")).alias("logp"))

    def left_after(self, k: int) -> DataFrame:
        """For every context of order k + 1: total and kinds that its last k bytes have besides the symbols it knows itself."""
        own = self.grams[k + 1].select(F.shiftright("key", 8).alias("longer"), _shorter("key", k).alias("key"))
        out = own.join(self.grams[k], "key").groupBy("longer").agg(F.sum("n").alias("excluded"), F.count(F.lit(1)).alias("known"))
        whole = out.withColumn("context", F.col("longer").bitwiseAND(F.lit((1 << (8 * k)) - 1))).join(self.stats[k], "context")
        return whole.select("longer", (F.col("total") - F.col("excluded")).alias("total_left"), (F.col("kinds") - F.col("known")).alias("kinds_left"))

    def unseen(self, keys: DataFrame) -> DataFrame:
        """(key, logp) of grams that training did not see, escape by escape."""
        rows = keys.select(F.col("key").alias("whole"), F.lit(0.0).alias("logp"), F.lit(False).alias("entered"), F.lit(False).alias("done"))
        for k in range(ORDER, -1, -1):
            gram, context = _shorter("whole", k), F.shiftright(_shorter("whole", k), 8)
            rows = rows.withColumns({"key": gram, "context": context}).join(self.stats[k], "context", "left")
            if k < ORDER:
                rows = rows.withColumn("longer", F.shiftright(_shorter("whole", k + 1), 8)).join(self.left_after(k), "longer", "left")
                rows = rows.join(self.grams[k], "key", "left")
            else:
                rows = rows.withColumns({"total_left": F.lit(None).cast("long"), "kinds_left": F.lit(None).cast("long"), "n": F.lit(None).cast("long")})
            total = F.when(F.col("entered"), F.col("total_left")).otherwise(F.col("total"))
            kinds = F.when(F.col("entered"), F.col("kinds_left")).otherwise(F.col("kinds"))
            rows = rows.withColumns({"t": total.cast("double"), "d": kinds.cast("double")})
            here = F.when(F.col("n").isNotNull(), F.log10((F.col("n") - 0.5) / F.col("t"))).when(
                F.col("d") > 0, F.log10(F.col("d") * 0.5 / F.col("t"))).otherwise(F.lit(0.0))
            rows = rows.select(
                "whole", F.when(F.col("done"), F.col("logp")).otherwise(F.col("logp") + here).alias("logp"),
                (F.col("entered") | F.col("kinds").isNotNull()).alias("entered"), (F.col("done") | F.col("n").isNotNull()).alias("done"))
            rows = materialise(rows, "ppm-escapes")
        known = self.stats[0].agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]
        last = -math.log10(SYMBOLS - known)
        return rows.select(F.col("whole").alias("key"), F.when(F.col("done"), F.col("logp")).otherwise(F.col("logp") + last).alias("logp"))


def score(docs: DataFrame, training: Column, most: int = FREQUENT, bits: int = SLOT_BITS) -> DataFrame:
    """Score the rows of ``docs`` (doc_id, text) by a model of the rows where ``training`` holds."""
    spark = docs.sparkSession
    counted = materialise(counts(docs.filter(training)), "ppm-counts")
    words = counted.filter("kind = 1").select("key", "n")
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = totals["n"], totals["v"]
    trie = Trie(counted.filter("kind = 0").select("key", "n"))
    seen = materialise(trie.seen(), "ppm-seen")
    tables = spark.sparkContext.broadcast((frequent(seen, "n", "logp", most, bits), frequent(words, "n", "n", most, bits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram_table, word_table = tables.value
        hashes, row = WordHashes(), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in (part for whole in batches for part in cut_by_bytes(whole, "text")):
            texts = [(t.as_py() or "").encode().lower() for t in batch.column("text")]
            logp, rest = np.zeros(len(texts)), ([], [])
            for grams, of in pieces(texts):
                value, kept = gram_table.find(grams)
                logp += np.bincount(of, value, len(texts))
                rest[0].append(of[~kept])
                rest[1].append(grams[~kept])
            tokens, known, base, word_rest = [], [], [], ([], [])
            for at, text in enumerate(texts):
                keys = np.append(word_keys(text, hashes), END_WORD)
                c, kept = word_table.find(keys)
                tokens.append(len(keys))
                known.append(int(kept.sum()))
                base.append(float(np.log10((c[kept] + 1) / (n + v + 1)).sum()))
                word_rest[0].append(np.full(int((~kept).sum()), at))
                word_rest[1].append(keys[~kept])
            arrays = [_by_text(*(np.concatenate(x) for x in r), len(texts)) for r in (rest, word_rest)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(texts))), batch.column("doc_id"), batch.column("held_out"), pa.array(tokens, pa.int64()),
                 pa.array(known, pa.int64()), pa.array(base), pa.array(logp), arrays[0], arrays[1]],
                ["row", "doc_id", "held_out", "n_tokens", "known", "base", "logp", "grams", "words"])
            row += len(texts)

    kind = dict(docs.dtypes)["doc_id"]
    rare = "array<struct<key:bigint,times:bigint>>"
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, logp double, grams {rare}, words {rare}"
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), (~training).alias("held_out")).mapInArrow(run, schema)
    rows = materialise(rows, "ppm-rows")  # fixes the row numbers

    rare_grams = rows.select("row", F.explode("grams").alias("x")).select("row", "x.*")
    unseen = materialise(rare_grams.select("key").distinct().join(seen, "key", "left_anti"), "ppm-unseen")
    logps = seen.select("key", "logp").union(trie.unseen(unseen))
    more = rare_grams.join(logps, "key").groupBy("row").agg(F.sum(F.col("times") * F.col("logp")).alias("more_logp"))
    rare_words = rows.select("row", F.explode("words").alias("x")).select("row", "x.*").join(words, "key", "left")
    more_words = rare_words.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(n + v + 1)))).alias("more_base"))
    nothing = F.lit(0)
    return rows.select("row", "doc_id", "held_out", "n_tokens", "known", "base", "logp").join(more, "row", "left").join(more_words, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", nothing)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("logp") + F.coalesce("more_logp", F.lit(0.0))).alias("score"))


def _by_text(of: np.ndarray, keys: np.ndarray, texts: int) -> pa.ListArray:
    """For each text of a batch the list of its keys with their numbers."""
    order = np.lexsort((keys, of))
    of, keys = of[order], keys[order]
    starts = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (keys[1:] != keys[:-1])])) if len(of) else np.zeros(0, int)
    times = np.diff(np.append(starts, len(of)))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(of[starts], minlength=texts))]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(keys[starts]), pa.array(times.astype(np.int64))], ["key", "times"])
    return pa.ListArray.from_arrays(pa.array(offsets), pairs)


def op4_ppm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fold_of("doc_id", HELD_OUT_PARTS) != HELD_OUT)
