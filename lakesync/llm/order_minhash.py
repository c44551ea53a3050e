"""Order MinHash: fingerprints that follow edit distance, since they keep the order of what they select.

A text's k-mers (runs of ``K`` words; a shorter text is one k-mer) are numbered by occurrence, so that a repeated k-mer
counts as often as it stands there.  A hash of the numbered k-mers plays the part of all permutations at once: its first
bits deal them into ``BINS`` parts, and in every part the ``PICKED`` smallest are selected.  The selected k-mers of a part,
put back into text order, are hashed to one element of the signature.  The likeness of two signatures is the share of equal
elements among the parts that either text has.

All of it is DataFrame expressions inside the row.  A k-mer and its position share one long (34 bits of hash above 30 bits
of position), so the sorts are sorts of numbers; k-mers of one text whose 34 bits agree count as repeats of one k-mer.

Defined results: a null text is empty; an empty text has no k-mers and a fingerprint of dashes; two empty texts are alike
(1.0), an empty and another one are not (0.0); rows with the same id follow each other in the order of a hash of their
texts; rows without an id come first; a table of one row is its own next document.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesync.llm.common import materialise, split_words, text_or_empty

K = 2
BINS = 32
PICKED = 2
POSITION_BITS = 30
#: Documents of a block of neighbours, up to a billion documents; from there on there are so many borders and blocks grow.
BLOCK = 1024
MAX_BORDERS = 1 << 20
_LOW = (1 << POSITION_BITS) - 1


def _at(array: Column, i: Column) -> Column:
    return F.get(array, i.cast("int"))


def _kmer(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, POSITION_BITS)


def _position(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(_LOW))


def _pack(value: Column, position: Column) -> Column:
    return value.bitwiseAND(F.lit(~_LOW)).bitwiseOR(position.cast("long"))


def _bin(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 64 - int(math.log2(BINS))).cast("int")


def add_signature(df: DataFrame, text: str, into: str) -> DataFrame:
    """Add the signature of a text column: ``BINS`` numbers, null where the text has no k-mer of that part."""
    words, kmers, packed, sorted_, seen = (F.col(f"__{c}") for c in ("hashes", "kmers", "packed", "sorted", "seen"))
    numbered, picks, parts = (F.col(f"__{c}") for c in ("numbered", "picks", "parts"))
    count = F.greatest(F.size(words) - (K - 1), F.least(F.size(words), F.lit(1)))
    new_run = lambda x, i: F.when((i == 0) | (_kmer(x) != _kmer(_at(sorted_, i - 1))), i)
    runs = F.col("__runs")
    ordinals = F.flatten(F.transform(runs, lambda r, j: F.sequence(
        F.lit(0), F.coalesce(_at(runs, j + 1), F.size(sorted_)) - r - 1)))
    ordinal = lambda i: F.when(F.size(seen) > 0, _at(seen, i)).otherwise(F.lit(0))
    among_first = lambda x, i: (i < PICKED) | (_bin(_at(numbered, i - PICKED)) != _bin(x))

    def element(x: Column, i: Column) -> Column:
        """Of the first pick of each part: the part and the hash of its picks in text order."""
        y = _at(picks, i + 1)
        alone = y.isNull() | (_bin(y) != _bin(x))
        pair = F.when(_position(x) <= _position(y), F.xxhash64(_kmer(x), _kmer(y))).otherwise(F.xxhash64(_kmer(y), _kmer(x)))
        first = (i == 0) | (_bin(_at(picks, i - 1)) != _bin(x))
        value = F.when(alone, F.xxhash64(_kmer(x))).otherwise(pair).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.when(first, F.struct(_bin(x).alias("part"), value.alias("value")))

    none = F.array().cast("array<int>")
    return (
        df.withColumn("__hashes", F.transform(split_words(F.col(text)), lambda w: F.xxhash64(w)))
        .withColumn("__kmers", F.transform(F.slice(words, 1, count), lambda h, i: F.xxhash64(h, *(_at(words, i + j) for j in range(1, K)))))
        .withColumn("__packed", F.transform(kmers, lambda h, i: _pack(h, i)))
        .withColumn("__repeats", F.size(F.array_distinct(kmers)) < F.size(kmers))
        .withColumn("__sorted", F.when(F.col("__repeats"), F.sort_array(packed)).otherwise(packed))
        .withColumn("__runs", F.when(F.col("__repeats"), F.filter(F.transform(sorted_, new_run), lambda r: r.isNotNull())).otherwise(none))
        .withColumn("__seen", F.when(F.size(runs) > 0, ordinals).otherwise(none))
        .withColumn("__numbered", F.sort_array(F.transform(sorted_, lambda x, i: _pack(F.xxhash64(_kmer(x), ordinal(i)), _position(x)))))
        .withColumn("__picks", F.filter(numbered, among_first))
        .withColumn("__parts", F.map_from_entries(F.filter(F.transform(picks, element), lambda e: e.isNotNull())))
        .withColumn(into, F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.when(F.size(parts) > 0, parts[b])))
        .drop(*(f"__{c}" for c in ("hashes", "kmers", "packed", "repeats", "sorted", "runs", "seen", "numbered", "picks", "parts")))
    )


def fingerprint(signature: Column) -> Column:
    """A signature as text, eight characters for each part."""
    shown = F.transform(signature, lambda x: F.coalesce(F.lpad(F.lower(F.hex(x)), 8, "0"), F.lit("-" * 8)))
    return F.array_join(shown, "")


def likeness(a: Column, b: Column) -> Column:
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0))), F.lit(0), lambda n, x: n + x)
    either = F.aggregate(F.zip_with(a, b, lambda x, y: (x.isNotNull() | y.isNotNull()).cast("int")), F.lit(0), lambda n, x: n + x)
    return F.when(either == 0, F.lit(1.0)).otherwise(equal / either.cast("double"))


def _borders(ids: DataFrame) -> list[tuple[int | None, int]]:
    """The first (doc_id, __hash) of each block, in order.

    The narrow pairs are range-sorted and every n-th of them begins a block, so blocks have n rows at most whatever the ids:
    gaps, missing ids and repeats make none larger.  There are ``MAX_BORDERS`` of them at most beside one per task of the sort.
    """
    pairs = materialise(ids.select(F.col("doc_id").cast("long").alias("d"), F.col("__hash").alias("h")), "block-pairs")
    size = max(BLOCK, -(-pairs.count() // MAX_BORDERS))
    order = [F.col("d").asc_nulls_first(), F.col("h"), F.col("row")]  # equal pairs are told apart, so that they split too
    ordered = pairs.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # within its task
    firsts = ordered.withColumn("place", place).filter(F.col("place") % size == 0).select("d", "h").collect()
    return sorted(((r["d"], r["h"]) for r in firsts), key=lambda b: (b[0] is not None, b[0] or 0, b[1]))


def with_next(docs: DataFrame, ids: DataFrame, carried: list[str]) -> DataFrame:
    """Add ``next``, a struct of the carried columns of the next row by id; after the last row comes the first.

    ``docs`` has doc_id and __hash, like ``ids``.  A row finds its block by binary search among the borders.  Rows are dealt
    out by block and sorted inside; those that equal the border of their block go to the block before it as well, as the
    neighbour of its last row.  So texts are shuffled once and joined with nothing.  Equal rows that fill several blocks are
    spread over them; within such blocks each is its neighbour's next.
    """
    borders = _borders(ids)
    listed = F.from_json(F.lit(json.dumps([{"d": d, "h": h} for d, h in borders])), "array<struct<d:bigint,h:bigint>>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, len(borders).bit_length())))))
    own = F.struct(F.col("doc_id").cast("long").alias("d"), F.col("__hash").alias("h"))

    def found(holds) -> Column:
        """The number of borders, from the first on, for which the comparison with the row holds."""
        return F.aggregate(steps, F.lit(0), lambda n, s: F.when(holds(F.get(listed, n + s - 1)), n + s).otherwise(n))

    low, high = F.col("__low"), F.col("__high")
    is_first = high > low
    block = F.when(is_first, low + F.pmod(F.xxhash64("__row"), F.greatest(high - low, F.lit(1))).cast("int")).otherwise(low - 1)
    here = F.struct(F.col("__block").alias("block"), F.lit(False).alias("visits"))
    before = F.struct(F.pmod(F.col("__block") - 1, F.lit(max(1, len(borders)))).alias("block"), F.lit(True).alias("visits"))
    placed = (
        docs.withColumn("__row", F.monotonically_increasing_id())
        .withColumn("__low", found(lambda border: border < own))
        .withColumn("__high", F.when(F.get(listed, low) == own, found(lambda border: border <= own)).otherwise(low))
        .withColumn("__block", block)
    )
    dealt = placed.withColumn("__at", F.explode(F.when(is_first, F.array(here, before)).otherwise(F.array(here))))
    ordered = Window.partitionBy("__at.block").orderBy("__at.visits", F.col("doc_id").asc_nulls_first(), "__hash")
    following = dealt.drop("__row", "__low", "__high", "__block").withColumn("next", F.lead(F.struct(*carried)).over(ordered))
    return following.filter(~F.col("__at.visits")).drop("__at")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, the fingerprints of the text and its edited form, and the likenesses."""
    text = text_or_empty()
    read = docs.select("doc_id", text.alias("__text")).withColumn("__hash", F.xxhash64("__text"))
    followed = with_next(add_signature(read, "__text", "__signature"), read.select("doc_id", "__hash"), ["__text", "__signature"])
    chars = F.length("__text")
    half = F.floor(chars / 2).cast("int")
    edited = F.concat(F.substr("__text", F.lit(1), chars - half), F.substr(F.col("next.__text"), F.lit(1), half))
    parts = followed.select("doc_id", chars.cast("long").alias("n_chars"), edited.alias("__edited"), "__signature",
                            F.col("next.__signature").alias("__next"))
    return add_signature(parts, "__edited", "__changed").select(
        "doc_id", "n_chars", F.sha2("__edited", 256).alias("edited_sha256"),
        fingerprint(F.col("__signature")).alias("fingerprint"), fingerprint(F.col("__changed")).alias("edited_fingerprint"),
        likeness(F.col("__signature"), F.col("__changed")).alias("near_edited"),
        likeness(F.col("__signature"), F.col("__next")).alias("near_next"))


def op8_order_minhash(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
