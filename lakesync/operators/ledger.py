"""Table summaries and folds over run ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lakesync.operators.extract import OBJECT


def table_summary(df: DataFrame, kind: str, order: Sequence[str], sample: int = 3) -> DataFrame:
    """One row: kind, row count, sorted field names, and the first rows as compact JSON."""
    fields = sorted(df.columns)
    rows = df.orderBy(*order).limit(max(sample, 0)).select(F.struct(*order).alias("o"), F.to_json(F.struct(*fields)).alias("j"))
    listed = rows.agg(F.sort_array(F.collect_list(F.struct("o", "j"))).getField("j"))
    return df.agg(F.count("*").alias("count")).select(
        F.lit(kind).alias("kind"), "count", F.lit(",".join(fields)).alias("fields"),
        F.concat(F.lit("["), F.array_join(listed.scalar(), ","), F.lit("]")).alias("sample"),
    )


def record_fields(df: DataFrame, record: str) -> DataFrame:
    """Union of field names of schemaless records, with the number of rows that have each."""
    names = F.map_keys(F.try_variant_get(F.col(record), "$", OBJECT))
    return df.select(F.explode(names).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def token_estimate(df: DataFrame, compact: Column, verbose: Column, by: Sequence[str] = ()) -> DataFrame:
    """Token estimate of encoded rows (a quarter of their bytes), compact against verbose."""
    def quarter(name: str) -> Column:
        return F.floor(F.col(name) / 4).cast("bigint")

    sums = df.groupBy(*by).agg(
        F.count("*").alias("rows"), F.sum(F.octet_length(compact) + 1).alias("compact_bytes"),
        F.sum(F.octet_length(verbose) + 1).alias("verbose_bytes"),
    )
    return sums.withColumns(
        {"compact_tokens": quarter("compact_bytes"), "verbose_tokens": quarter("verbose_bytes")}
    )


def upsert_runs(ledger: DataFrame, seq: str, key: str, fixed: Sequence[str], updated: Sequence[str]) -> DataFrame:
    """Run rows folded by id: first write keeps ``fixed``, last write gives ``updated``."""
    folded = ledger.groupBy(key).agg(
        F.min_by(F.struct(*fixed), F.col(seq)).alias("a"), F.max_by(F.struct(*updated), F.col(seq)).alias("z")
    )
    return folded.select(key, "a.*", "z.*")


def throughput(runs: DataFrame, mode: str, records: str, seconds: str) -> DataFrame:
    """Runs, records, average duration and records per second of each mode."""
    sums = runs.groupBy(mode).agg(
        F.count("*").alias("iterations"), F.sum(records).alias("records"),
        F.sum(F.col(seconds).cast("decimal(18,6)")).alias("total"),
    )
    total = F.col("total").cast("double")
    return sums.select(
        mode, "iterations", "records", (total / F.col("iterations")).alias("average_seconds"),
        F.when(total > 0, F.col("records") / total).otherwise(0.0).alias("records_per_second"),
    )


def open_entries(entries: DataFrame, tag: str, facts: Sequence[str], threshold: Column) -> DataFrame:
    """Tags that were planned by the threshold and never cleaned, with facts of the last plan."""
    planned = F.col("planned_at").isNotNull()
    folded = entries.groupBy(tag).agg(
        F.max_by(F.struct("planned_at", *facts), F.when(planned, F.col("seq"))).alias("p"),
        F.max("cleaned_at").alias("cleaned_at"),
    )
    return folded.where(F.col("cleaned_at").isNull() & (F.col("p.planned_at") <= threshold)).select(tag, "p.*")


def capability_matrix(
    results: DataFrame, actions: DataFrame, source: str, checks: Sequence[str],
    mode_checks: Sequence[str] = (),
) -> DataFrame:
    """One row per source, one column per check; ``results`` also carries ``leaked`` and ``skipped``.

    The write column is ``pass`` unless an action failed; then it is the last
    such result in action-name order.  A skipped source shows ``skip``, and
    nothing in the columns of ``mode_checks``.
    """
    wide = results.groupBy(source).agg(
        F.bool_or("leaked").alias("leaked"), F.bool_or("skipped").alias("skipped"),
        *(
            F.max(F.when(F.col("check") == c, F.nullif(F.col("result"), F.lit("")))).alias(c)
            for c in [*checks, *mode_checks]
        ),
    )
    bad = ~F.col("result").isin("pass", "skipped")
    write = actions.groupBy(source).agg(
        F.coalesce(F.max_by("result", F.when(bad, F.col("action"))), F.lit("pass")).alias("write")
    )
    skip = F.col("skipped")
    return wide.join(write, source, "left").select(
        source, "leaked",
        *(
            F.when(skip, "" if c in mode_checks else "skip").otherwise(F.coalesce(F.col(c), F.lit("uncert"))).alias(c)
            for c in [*checks, *mode_checks, "write"]
        ),
    )
