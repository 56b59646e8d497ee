"""Connected components of a table of links, by built-in functions alone.

Distributed union-find: large-star and small-star steps in turn, until each node points at the smallest of its
component. Minima are taken before rows are dealt by node, and the joins' inputs are written tables, so that a node
with very many links is split among tasks. Each round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.shared import Workspace

ROUNDS = 60


def state_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, work: Workspace, label: str = "components") -> DataFrame:
    """links (a, b), longs in any order and number, to (node, root) for each node of a link; root is the smallest."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = work.keep(edges, f"{label}-0")
    before = state_of(edges)
    for i in range(1, ROUNDS + 1):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = work.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{label}-large-{i}")
        large = work.keep(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{label}-edges-{i}")
        lowest = work.keep(large.groupBy("u").agg(F.min("v").alias("m")), f"{label}-small-{i}")
        moved = large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = work.keep(moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), f"{label}-{i}")
        after = state_of(edges)
        for old in (f"{label}-large-{i}", f"{label}-edges-{i}", f"{label}-small-{i}", f"{label}-{i - 1}"):
            work.drop(old)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components haven't settled in {ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
