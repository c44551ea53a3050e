"""Collocations from count streams kept in prefix order and in suffix order.

Counting goes one order at a time: words, pairs, triples.  Tasks count blocks of about ``BLOCK_BYTES`` of text by sorting
codes, so that a frequent phrase leaves a block as one row; Spark adds the blocks up.  A phrase that reaches ``MIN_COUNT`` has
only parts that reach it, so pairs of rare words and triples of rare pairs need not be counted: a sieve of fixed size (one bit
for every hash of a frequent shorter phrase) tells the tasks which to leave out.  Its false alarms cost time only.

The frequent phrases, a stream closed under taking parts, are then range-sorted twice.  In prefix order every phrase follows
its first word and its first two words, so one walk with two running counts gives all left counts; in suffix order the same
walk gives all right counts.  A phrase that carries on into the next range gets its counts from one summary row per range, so a
hot word is spread over as many tasks as its rows need, and no row is looked up by hash.  The triples know the counts of the two
pairs in them by then, and so tell which pairs they stand for.

Defined results: a null text has no words, a null lang is ``und``, repeated rows count each time, an empty table gives an empty
result, ties are ranked by the phrase's bytes.  A very long text is a block of its own.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakesync.llm.common import materialise, text_or_empty
from lakesync.operators.ordered import row_index

PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
GAPS = b" \t"
NO_LANG = "und"
MIN_COUNT = 10
#: A pair goes where a triple around it has at least this percentage of its count.
COVERED_PERCENT = 50
TOP = 2000
BLOCK_BYTES = 1 << 20
#: Rows of one Arrow batch that a task hands back.
OUT_ROWS = 1 << 15
#: Bits of a sieve, whatever the corpus; 16 MB.
SIEVE_BITS = 1 << 27
#: Positions of one of Spark's bitmaps.
BITMAP = 32768

WORDS = ("w1", "w2", "w3")


class _Kinds:
    WORD, GAP, END = 0, 1, 2
    table = np.zeros(256, np.uint8)


_Kinds.table[list(GAPS)] = _Kinds.GAP
_Kinds.table[list(PIECE_ENDS)] = _Kinds.END


def _tokens(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of ``data``, and for every word in order its number among them and its piece."""
    kinds = _Kinds.table[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(kinds == _Kinds.WORD, prepend=False, append=False)).astype(np.int64)
    piece = np.cumsum(kinds == _Kinds.END)[edges[0::2]]
    if not len(edges):
        return pa.array([], pa.binary()), np.zeros(0, np.int64), piece
    # Words and what stands between them take turns.
    runs = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])
    words = runs.take(pa.array(np.arange(0, len(edges) - 1, 2))).dictionary_encode()
    return words.dictionary, words.indices.to_numpy().astype(np.int64), piece


def _word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = first * np.uint64(0x9E3779B97F4A7C15) + (second ^ (second >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(SIEVE_BITS)).astype(np.int64)


def _passes(sieve: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slots = _slots(hashes)
    return (sieve[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def _count_block(data: bytes, lang: str, order: int, sieve: np.ndarray | None) -> tuple[pa.Array, np.ndarray]:
    """The distinct phrases of ``order`` words that pass the sieve, their words joined by spaces, and their counts."""
    words, ids, piece = _tokens(data)
    n = max(len(words), 1)
    if order == 1:
        codes, counts = np.unique(ids, return_counts=True)
        places = [codes]
    else:
        hashes = _word_hashes(words.to_pylist(), lang)
        pairs = piece[:-1] == piece[1:]
        if order == 2:
            known = _passes(sieve, hashes)
            at = np.flatnonzero(pairs & known[ids[:-1]] & known[ids[1:]])
            codes, counts = np.unique(ids[at] * n + ids[at + 1], return_counts=True)
            places = [codes // n, codes % n]
        else:
            pairs[pairs] = _passes(sieve, _pair_hashes(hashes[ids[:-1][pairs]], hashes[ids[1:][pairs]]))
            at = np.flatnonzero(pairs[:-1] & pairs[1:])
            heads, head = np.unique(ids[at] * n + ids[at + 1], return_inverse=True)
            codes, counts = np.unique(head * n + ids[at + 2], return_counts=True)
            places = [heads[codes // n] // n, heads[codes // n] % n, codes % n]
    taken = [words.take(pa.array(p)) for p in places]
    joined = taken[0] if order == 1 else pc.binary_join_element_wise(*taken, pa.scalar(b" ", taken[0].type))
    return joined.cast(pa.string()), counts


def _counter(order: int, sieve):
    """For mapInArrow over (lang, text as bytes): rows (lang, phrase, f), counted by blocks of one language."""
    def counted(lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        bits = None if sieve is None else sieve.value
        phrases, counts = _count_block(b"\n".join(texts).lower(), lang, order, bits)
        for at in range(0, len(counts), OUT_ROWS):
            f = pa.array(counts[at:at + OUT_ROWS], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(f)), phrases.slice(at, OUT_ROWS), f], ["lang", "phrase", "f"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list[bytes], int]] = {}
        total = 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                lang, text = lang.as_py(), text.as_py()
                texts, size = held.get(lang, ([], 0))
                texts.append(text)
                held[lang] = texts, size + len(text)
                total += len(text)
                if held[lang][1] >= BLOCK_BYTES:
                    texts, size = held.pop(lang)
                    total -= size
                    yield from counted(lang, texts)
                elif total >= 4 * BLOCK_BYTES:  # many languages at once
                    for name, (texts, _) in held.items():
                        yield from counted(name, texts)
                    held, total = {}, 0
        for lang, (texts, _) in held.items():
            yield from counted(lang, texts)

    return count


def phrase_counts(docs: DataFrame, order: int, sieve=None) -> DataFrame:
    """(lang, phrase, f) of the phrases of ``order`` words; the phrases that the sieve rules out are left out."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), text_or_empty().cast("binary").alias("text"))
    return texts.mapInArrow(_counter(order, sieve), "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _slots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, places = batch.column(0).to_pylist(), list(zip(*(p.encode().split(b" ") for p in batch.column(1).to_pylist()), strict=True))
        hashes = [np.fromiter((xxhash.xxh3_64_intdigest(w, xxhash.xxh32_intdigest(x.encode())) for x, w in zip(lang, p, strict=True)),
                              np.uint64, len(lang)) for p in places]
        if not hashes:
            continue
        slots = _slots(hashes[0] if len(hashes) == 1 else _pair_hashes(*hashes))
        yield pa.RecordBatch.from_arrays([pa.array(slots)], ["slot"])


def sieve_of(phrases: DataFrame):
    """A broadcast array with one bit for every hash of ``phrases``; SIEVE_BITS / BITMAP rows of 4 KB reach the driver at most."""
    slots = phrases.select("lang", "phrase").mapInArrow(_slots_of, "slot long")
    maps = slots.groupBy(F.expr(f"slot div {BITMAP}").alias("part")).agg(F.bitmap_construct_agg(F.col("slot") % BITMAP).alias("bits"))
    sieve = np.zeros(SIEVE_BITS // 8, np.uint8)
    for row in maps.toLocalIterator():
        at = row["part"] * (BITMAP // 8)
        sieve[at:at + BITMAP // 8] = np.frombuffer(row["bits"], np.uint8)
    return phrases.sparkSession.sparkContext.broadcast(sieve)


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """The stream (lang, w1, w2, w3, f) of all phrases of one to three words that occur ``min_count`` times, and (lang, n)."""
    words = materialise(phrase_counts(docs, 1), "phrase-words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    stream, shorter = [], words.filter(F.col("f") >= min_count)
    stream.append(shorter)
    for order in (2, 3):
        longer = phrase_counts(docs, order, sieve_of(shorter)).filter(F.col("f") >= min_count)
        shorter = materialise(longer, f"phrases-{order}")
        stream.append(shorter)
    parts = F.split("phrase", " ")
    every = reduce(DataFrame.unionByName, stream)
    return every.select("lang", *(F.get(parts, F.lit(k)).alias(w) for k, w in enumerate(WORDS)), "f"), totals


def _walk(key2: int, key3: int, count: int):
    """Adds the range's number, the row's place in it and the counts of the one and two words that begin the row's keys."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, carried = TaskContext.get().partitionId(), 0, {1: -1, 2: -1}
        for batch in batches:
            f, rows = batch.column(count).to_numpy(), len(batch)
            n = 1 + batch.column(key2).is_valid().to_numpy(False).astype(int) + batch.column(key3).is_valid().to_numpy(False)
            seen = {}
            for k in (1, 2):
                last = np.maximum.accumulate(np.where(n == k, np.arange(rows), -1))
                seen[k] = np.where(last >= 0, f[last], carried[k])
                carried[k] = int(seen[k][-1]) if rows else carried[k]
            added = [pa.array(np.full(rows, part, np.int32)), pa.array(np.arange(at, at + rows)),
                     *(pa.array(seen[k], mask=(n <= k) | (seen[k] < 0)) for k in (1, 2)), pa.array(n.astype(np.int32))]
            at += rows
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "part", "at", "one", "two", "n_words"])

    return walk


def walk_in_order(stream: DataFrame, keys: list[str], one: str, two: str) -> DataFrame:
    """``stream`` with the counts of the shorter phrases that begin a row's ``keys``: of its first key, and of its first two.

    The stream holds those phrases, and in key order they come right before: the last row with one key, the last with two.
    A range that begins in the middle gets them from the ranges before, of which there is one summary row each.
    """
    names = stream.columns
    by = [F.col("lang"), *(F.col(k).asc_nulls_first() for k in keys)]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema) + ", part int, at long, one long, two long, n_words int"
    walk = _walk(names.index(keys[1]), names.index(keys[2]), names.index("f"))
    walked = materialise(stream.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(walk, schema), "phrase-walk")
    ends = walked.groupBy("part").agg(*(F.max_by("f", F.when(F.col("n_words") == k, F.col("at"))).alias(f"end{k}") for k in (1, 2)))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("part", *(F.last(f"end{k}", ignorenulls=True).over(earlier).alias(f"end{k}") for k in (1, 2)))
    longer = lambda k: F.col("n_words") > k
    return walked.join(F.broadcast(carried), "part").select(  # one row for each range
        *names, F.when(longer(1), F.coalesce("one", "end1")).alias(one), F.when(longer(2), F.coalesce("two", "end2")).alias(two))


def cut_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exactly, for counts of up to 15 digits."""
    wide = lambda c: c.cast("decimal(15,0)")
    above = (F.lit(1_000_000).cast("decimal(7,0)") * wide(a) * wide(a)).cast("decimal(38,0)")
    below = (wide(left) * wide(right)).cast("decimal(38,0)")
    return ((above - above % below) / below).cast("long")


def _cut(k: int, left: str, right: str) -> Column:
    score = cut_score(F.col("f"), F.col(left), F.col(right))
    return F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))


def collocations(docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases of two or three words."""
    stream, totals = frequent_phrases(docs, min_count)
    left = walk_in_order(stream, ["w1", "w2", "w3"], "l1", "l2")
    # The last word, the one before it, and the first of three.
    last = F.coalesce("w3", "w2", "w1")
    turned = left.withColumns({"k1": last, "k2": F.when(F.col("w3").isNotNull(), F.col("w2")).when(F.col("w2").isNotNull(), F.col("w1")),
                               "k3": F.when(F.col("w3").isNotNull(), F.col("w1"))})
    both = walk_in_order(turned, ["k1", "k2", "k3"], "r1", "r2").drop("k1", "k2", "k3").filter("w2 IS NOT NULL")
    cut = F.when(F.col("w3").isNull(), _cut(1, "l1", "r1")).otherwise(F.least(_cut(1, "l1", "r2"), _cut(2, "l2", "r1")))
    scored = materialise(both.withColumn("cut", cut), "phrase-scores")
    triples = scored.filter("w3 IS NOT NULL")
    covers = lambda part: F.col("f") * 100 >= F.col(part) * COVERED_PERCENT
    covered = triples.filter(covers("l2")).select("lang", "w1", "w2").union(
        triples.filter(covers("r2")).select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"))).distinct()
    pairs = scored.filter("w3 IS NULL").join(covered, ["lang", "w1", "w2"], "left_anti").select(scored.columns)
    kept = pairs.unionByName(triples).select(
        "lang", F.concat_ws(" ", *WORDS).alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
    placed = row_index(kept, [F.col("lang"), F.col("score").desc(), F.col("a").desc(), F.col("phrase")], "place")
    firsts = placed.groupBy("lang").agg(F.min("place").alias("first")).join(totals, "lang")
    return (
        placed.join(F.broadcast(firsts), "lang")  # one row for each language
        .withColumn("rank", F.col("place") - F.col("first") + 1).filter(F.col("rank") <= top)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL11 = r"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\n\x0B\f\r]')) AS piece FROM d),
    w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p),
    n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
    g AS (SELECT lang, 1 AS k, unnest(ws) AS phrase FROM w
          UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w WHERE len(ws) > 1
          UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w WHERE len(ws) > 2),
    f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 10),
    s AS (SELECT *, string_split(phrase, ' ') AS x FROM f),
    c AS (SELECT s.lang, s.k, s.phrase, s.f AS a, j, l.f AS l, r.f AS r, ((1000000::HUGEINT * s.f * s.f) // (l.f::HUGEINT * r.f))::BIGINT AS score
          FROM s, (SELECT unnest([1, 2]) AS j), f l, f r
          WHERE j < s.k AND l.lang = s.lang AND l.k = j AND l.phrase = array_to_string(s.x[1:j], ' ')
            AND r.lang = s.lang AND r.k = s.k - j AND r.phrase = array_to_string(s.x[j + 1:s.k], ' ')),
    b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
    u AS (SELECT lang, array_to_string(x[1:2], ' ') AS phrase, f FROM s WHERE k = 3 UNION ALL SELECT lang, array_to_string(x[2:3], ' '), f FROM s WHERE k = 3),
    v AS (SELECT lang, phrase, max(f) AS longest FROM u GROUP BY lang, phrase),
    o AS (SELECT b.* FROM b LEFT JOIN v ON b.lang = v.lang AND b.phrase = v.phrase WHERE NOT coalesce(100 * v.longest >= 50 * b.a, false))
    SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM o JOIN n ON o.lang = n.lang QUALIFY rank <= 2000
"""
