"""Mixing sources to target weights with hash-random keys and distributed prefix sums.

Every document gets a key from a hash of its id and text.  Within a source the documents are range-sorted by key and
the prefix sums of their sizes are computed range by range; a source's budget is then a cut in that order.  A source
whose budget exceeds its size is taken whole as often as the budget asks (its epochs), and the rest of the budget cuts
the last epoch at the document whose middle lies nearest to it.

Defined results: a null source is a source of its own, sorted last; a null or empty text has size 0 and is taken 0
times; repeated rows have the same key, are neighbours and count separately; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesync.llm.common import free_names, hash_key, materialise, running_totals, text_or_empty, word_count

#: A source's target stops at so many times its size.
MAX_EPOCHS = 3
#: Weights of the sources in code point order, repeated.
WEIGHTS = (1, 2, 3)
_SOURCE = ["__no_source", "__source"]


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to one row per source: shares by weight, limited to ``max_epochs`` sizes, the excess reshared.

    The limited sources are those of the smallest size per weight.  Of all the levels (words per unit of weight) that
    arise when the first i sources of that order are held at their limit, the largest is the one that holds at the end.
    """
    by_name = Window.orderBy(*_SOURCE)
    everything = Window.partitionBy()
    cycle = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("__rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("__rank", F.row_number().over(by_name) - 1).withColumn("__weight", cycle.cast("long"))
    limit = F.col("source_size") * max_epochs
    ratio = Window.orderBy(limit.cast("double") / F.col("__weight"), *_SOURCE)
    left = F.sum("source_size").over(everything) - F.coalesce(
        F.sum(limit).over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight_left = F.sum("__weight").over(ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return (
        ranked.withColumn("__level", left.cast("double") / weight_left)
        .withColumn("__level", F.max("__level").over(everything))
        .withColumn("target", F.least(limit.cast("double"), F.col("__level") * F.col("__weight")))
        .select(*_SOURCE, "source_size", "target")
    )


def mix(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sized``: rows with doc_id, source, size and key.  Adds source_size, target, copies and taken."""
    grouped = sized.withColumns({"__no_source": F.col("source").isNull(),
                                 "__source": F.coalesce(F.col("source"), F.lit(""))})
    totals = source_targets(grouped.groupBy(*_SOURCE).agg(F.sum("size").alias("source_size")), weights, max_epochs)
    placed = running_totals(grouped, _SOURCE, "key", "size", ["doc_id", "size"]).join(totals, _SOURCE)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - F.col("__epochs") * F.col("source_size")
    inside = F.col("before") + F.col("size") / F.lit(2.0) <= rest
    return (
        placed.withColumn("__epochs", epochs.cast("long"))
        .withColumn("copies", F.when(F.col("size") > 0, F.col("__epochs") + inside.cast("long")).otherwise(F.lit(0)).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop(*_SOURCE, "__epochs", "before", "slot")
    )


def sized_documents(docs: DataFrame, *row: str) -> DataFrame:
    """The narrow table that is mixed: the texts themselves are never shuffled.  ``row`` columns tell equal rows apart."""
    text = text_or_empty()
    key = hash_key(F.col("doc_id"), F.md5(text.cast("binary")), *(F.col(r) for r in row))
    return docs.select("doc_id", "source", word_count(text).alias("size"), key.alias("key"), *row)


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mix(materialise(sized_documents(docs), "mix-sizes"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each row as often as it is taken, with the columns of ``docs``.

    Rows are numbered in a table of their own first, so that equal ones are taken one by one.
    """
    row, copy = free_names(docs, "__row", "__copy")
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    plan = mix(materialise(sized_documents(numbered, row), "mix-sizes")).filter("copies > 0").select(row, F.col("copies").cast("int").alias(copy))
    repeated = numbered.join(plan, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy))))
    return repeated.select(*docs.columns)


SQL9 = r"""
    WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> ''))::BIGINT AS size,
                      md5(coalesce(doc_id::VARCHAR, chr(0)) || chr(31) || md5(coalesce(text, ''))) AS k FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
    l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                    / sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST
                       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM w),
    t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, (max(level) OVER ()) * weight) AS target FROM l),
    p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
                 sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before,
                 CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
           (size * (epochs + CASE WHEN before + size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM p
"""
