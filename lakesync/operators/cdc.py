"""Change data capture over landed change messages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lakesync.operators.extract import last_named
from lakesync.operators.relational import asof_join
from lakesync.operators.shape import decode_text
from lakesync.workspace import fresh_dir

OPERATIONS = {"I": "insert", "U": "update", "D": "delete"}


def lsn_position(lsn: Column) -> Column:
    """Log position ``high/low`` (hex) as one BIGINT."""
    def half(i: int) -> Column:
        return F.conv(F.split_part(lsn, F.lit("/"), F.lit(i)), 16, 10).cast("bigint")

    return F.shiftleft(half(1), 32) + half(2)


#: So many versions of relations, with their column lists, are sent to every task at most.
SMALL_VERSIONS = 200_000


def bind_relations(
    changes: DataFrame, relations: DataFrame, take: Sequence[str], at: str = "position", tie: str = "position",
    hot_rows: int | None = None, slices: int | None = None, small_versions: int | None = None,
) -> DataFrame:
    """Each change with the latest relation definition at or before it; an unknown relation fails.

    Definitions are few beside changes.  Where they are counted to be, tasks look them up and changes are not shuffled;
    otherwise both are sorted together.
    """
    spark, limit = changes.sparkSession, SMALL_VERSIONS if small_versions is None else small_versions
    path = fresh_dir(spark, "relation-versions")
    relations.write.parquet(path)
    stored = spark.read.schema(relations.schema).parquet(path)
    if stored.count() <= limit:
        bound = _look_up(changes, stored, take, at, tie)
    else:
        bound = asof_join(changes, stored, ["relation_id"], at, at, take, tie, tie, hot_rows=hot_rows, slices=slices)
    unknown = F.raise_error(
        F.concat(F.lit("change before its relation was defined: "), F.col("relation_id").cast("string"))
    ).cast(bound.schema[take[0]].dataType)
    return bound.withColumn(take[0], F.coalesce(F.col(take[0]), unknown))


def _look_up(changes: DataFrame, relations: DataFrame, take: Sequence[str], at: str, tie: str) -> DataFrame:
    """As-of join with versions that fit into every task.

    The log is cut into as many equal stretches as there are versions on average; a version stands in every stretch it is
    valid in, so that a change meets only a few, found by equality.  All versions together stand in no more places than twice
    their number.
    """
    last = F.max_by(F.struct(*take), F.col(tie)).alias("__take")
    versions = relations.groupBy("relation_id", F.col(at).alias("__from")).agg(last)
    facts = versions.agg(F.min("__from").alias("low"), F.max("__from").alias("high"), F.count("*").alias("n"),
                         F.count_distinct("relation_id").alias("relations")).first()
    if not facts.n:
        nothing = {name: F.lit(None).cast(relations.schema[name].dataType) for name in take}
        return changes.withColumns(nothing)
    stretches = max(1, facts.n // facts.relations)
    width = max(1, -(-(facts.high - facts.low + 1) // stretches))

    def stretch(place: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(stretches - 1), F.floor((place - F.lit(facts.low)) / F.lit(width)))).cast("int")

    ordered = Window.partitionBy("relation_id").orderBy("__from")
    spans = versions.withColumn("__next", F.lead("__from").over(ordered))
    to = F.coalesce(stretch(F.col("__next") - 1), F.lit(stretches - 1))
    placed = spans.withColumn("__stretch", F.explode(F.sequence(stretch(F.col("__from")), F.greatest(to, stretch(F.col("__from"))))))
    known = F.broadcast(placed.withColumnRenamed("relation_id", "__relation"))  # counted above
    here = F.col(at)
    fits = (
        (F.col("relation_id") == F.col("__relation")) & (stretch(here) == F.col("__stretch"))
        & (here >= F.col("__from")) & (F.col("__next").isNull() | (here < F.col("__next")))
    )
    return changes.join(known, fits, "left").select(*changes.columns, *(F.col("__take")[name].alias(name) for name in take))


CELLS = "array<struct<kind:string,text:string>>"


def _number(message: Column, at: Column, size: int) -> Column:
    """Big-endian number in ``size`` bytes from a 1-based place on."""
    return F.conv(F.hex(F.substr(message, at, F.lit(size))), 16, 10).cast("int")


def _mark(message: Column, at: Column) -> Column:
    return F.decode(F.substr(message, at, F.lit(1)), "UTF-8")


def _tuple_at(message: Column, start: Column) -> Column:
    """The cells of a row from a 1-based place on, and the place after it, in one walk over the cells."""
    count = _number(message, start, 2)
    steps = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))

    def step(state: Column, _: Column) -> Column:
        kind = _mark(message, state["at"])
        size = _number(message, state["at"] + 1, 4)
        text = F.when(kind == "t", F.decode(F.substr(message, state["at"] + 5, size), "UTF-8"))
        known = F.when(kind.isin("t", "n", "u"), kind).otherwise(F.raise_error(F.concat(F.lit("no such kind of cell: "), kind)).cast("string"))
        after = state["at"] + F.when(kind == "t", size + 5).otherwise(F.lit(1))
        return F.struct(after.alias("at"), F.concat(state["cells"], F.array(F.struct(known.alias("kind"), text.alias("text")))).alias("cells"))

    first = F.struct((start + 2).cast("int").alias("at"), F.array().cast(CELLS).alias("cells"))
    return F.aggregate(steps, first, step)


def decode_messages(messages: DataFrame, message: str, keep: Sequence[str]) -> DataFrame:
    """Binary change messages to ``op``, ``relation_id`` and cells of kind t(ext), n(ull) or u(nchanged).

    The cells are those of the row a change carries: the new one of an insert or update, the old one of a delete.
    Transaction and relation messages carry no row and are left out.
    """
    body = F.col(message)
    tag = _mark(body, F.lit(1))
    names = F.create_map(*(F.lit(v) for pair in OPERATIONS.items() for v in pair))
    unknown = F.raise_error(F.concat(F.lit("no such message type: "), tag)).cast("string")
    # An update may carry the old row, or its key, before the new one.
    has_old = (tag == "U") & _mark(body, F.lit(6)).isin("K", "O")
    at = F.when(has_old, _tuple_at(body, F.lit(7))["at"]).otherwise(F.lit(6))
    changes = messages.where(~tag.isin("B", "C", "R")).withColumn("__at", at)
    changes = changes.withColumn("__mark", _mark(body, F.col("__at"))).withColumn("__row", _tuple_at(body, F.col("__at") + 1))
    fits = F.when(tag == "D", F.col("__mark").isin("K", "O")).otherwise(F.col("__mark") == "N")
    cells = (
        F.when(~fits, F.raise_error(F.concat(F.lit("row mark "), "__mark", F.lit(" in a message of type "), tag)).cast(CELLS))
        .when(F.col("__row")["at"] != F.length(body) + 1, F.raise_error(F.lit("bytes left after the row")).cast(CELLS))
        .otherwise(F.col("__row")["cells"])
    )
    return changes.select(
        *keep, F.coalesce(F.try_element_at(names, tag), unknown).alias("op"), _number(body, F.lit(2), 4).cast("bigint").alias("relation_id"),
        cells.alias("cells"),
    )


def cdc_events(bound: DataFrame, columns: Mapping[str, str], keep: Sequence[str], names: str = "columns") -> DataFrame:
    """Typed columns of bound changes plus ``<column>_set``, which is false where the value was not sent.

    ``names`` is the relation's array of ``(name, type_id)``; ``columns`` maps output columns to kinds.
    """
    pairs = F.arrays_zip(F.col(f"{names}.name").alias("n"), F.col(names).alias("c"), F.col("cells").alias("v"))
    opened = bound.withColumn("__sent", F.filter(pairs, lambda p: p["v"].isNotNull()))
    # Each cell is looked up once and then read several times.
    opened = opened.withColumns({f"__{name}": last_named(F.col("__sent"), name) for name in columns})
    out = []
    for name, kind in columns.items():
        cell = F.col(f"__{name}")
        read = decode_text(cell["v"]["text"], cell["c"]["type_id"])
        out.append(read[f"{kind}_value"].alias(name))
        out.append(F.coalesce(cell["v"]["kind"] != "u", F.lit(False)).alias(f"{name}_set"))
    return opened.select(*keep, *out)


def change_folds(events: DataFrame, columns: Sequence[str], position: str, op: str = "op") -> list[Column]:
    """Aggregates over the events of a key: the newest event, the newest delete, and the newest value sent of each column
    with its position."""
    at, dead = F.col(position), F.col(op) == "delete"
    folds = [F.max(at).alias("__at"), F.max_by(op, at).alias("__op"), F.max(F.when(dead, at)).alias("__dead")]
    for name in columns:
        sent = ~dead & F.col(f"{name}_set") if f"{name}_set" in events.columns else ~dead
        when = F.when(sent, at)
        folds += [F.max_by(F.col(name), when).alias(name), F.max(when).alias(f"__at_{name}")]
    return folds


def fold_changes(events: DataFrame, keys: Sequence[str], columns: Sequence[str], position: str, op: str = "op") -> DataFrame:
    """One row per key with the folds of its events."""
    return events.groupBy(*keys).agg(*change_folds(events, columns, position, op))


def current_rows(folded: DataFrame, keys: Sequence[str], columns: Sequence[str], position: str, op: str = "op") -> DataFrame:
    """The table a folded log leaves: deleted keys are gone, and values from before a delete are not taken over."""
    alive = {
        name: F.when(F.col("__dead").isNull() | (F.col(f"__at_{name}") > F.col("__dead")), F.col(name))
        for name in columns
    }
    return folded.where(F.col("__op") != "delete").select(
        *keys, F.col("__at").alias(position), F.col("__op").alias(op), *(value.alias(name) for name, value in alive.items()))


def apply_changes(
    events: DataFrame, keys: Sequence[str], columns: Sequence[str], position: str, op: str = "op"
) -> DataFrame:
    """Current table from its change log: the last event per key, unchanged values from before.

    A ``<column>_set`` flag that is false means the value was not sent.  One
    aggregation, combined before the shuffle, so a hot key costs no more than
    any other.
    """
    return current_rows(fold_changes(events, keys, columns, position, op), keys, columns, position, op)
