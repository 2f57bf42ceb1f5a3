"""Connected components of a table of links, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantmetrics.session import materialise

MAX_STEPS = 64


def signature(links: DataFrame) -> tuple[int, int]:
    """Number of links and a sum over their hashes, which together tell whether a step changed anything."""
    row = links.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
    return row[0], row[1] or 0


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node it can reach) for every node of ``links`` (a, b: long).

    Every step joins each node's links with the node's smallest neighbour: first larger neighbours are linked to it, then
    smaller ones. Links of a component thereby gather at its smallest node in a number of steps that grows with the logarithm
    of its size. Groups are only ever reduced to their smallest member, so a node may have any number of links. Each step is
    written to the shared folder. The steps end when one changes nothing; ``MAX_STEPS`` without that are an error.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = materialise(edges, "links")
    seen = signature(edges)
    for _ in range(MAX_STEPS):
        if not seen[0]:
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
        edges = materialise(small.filter("a <> b").distinct(), "links")
        now = signature(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"the links still change after {MAX_STEPS} steps, so their components are not known")
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
