"""Connected components of a table of links, by contraction, without collecting any of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesync.llm.common import materialise


def _names(edges: DataFrame) -> DataFrame:
    """For every vertex the neighbour (or itself) whose hash is smallest; a hot vertex is combined before the shuffle."""
    both = edges.select("a", "b").union(edges.select("b", "a")).union(edges.select("a", "a")).union(edges.select("b", "b"))
    return both.groupBy("a").agg(F.min_by("b", F.xxhash64("b")).alias("name"))


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every vertex of ``links`` (a, b); the component is its smallest id.

    Every round gives each vertex the name of a neighbour and keeps the links between different names.  The order is
    random, so each round leaves about half of a chain's vertices and only the middle of a star, and a handful of rounds
    is enough for any graph.  The rounds' names are joined up at the end.
    """
    edges, rounds = materialise(links.select("a", "b").filter("a <> b").distinct(), "links"), []
    while not edges.isEmpty():
        names = materialise(_names(edges), "link-names")
        rounds.append(names)
        renamed = (
            edges.join(names.select("a", F.col("name").alias("x")), "a")
            .join(names.select(F.col("a").alias("b"), F.col("name").alias("y")), "b").filter("x <> y")
        )
        edges = materialise(renamed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if not rounds:
        return links.select(F.col("a").alias("id"), F.col("a").alias("component")).limit(0)

    def rename(named: DataFrame, names: DataFrame) -> DataFrame:
        return named.join(names.select(F.col("a").alias("name"), F.col("name").alias("next")), "name", "left").select(
            "a", F.coalesce("next", "name").alias("name"))

    named = reduce(rename, rounds[1:], rounds[0])
    smallest = named.groupBy("name").agg(F.min("a").alias("component"))
    return named.join(smallest, "name").select(F.col("a").alias("id"), "component")
