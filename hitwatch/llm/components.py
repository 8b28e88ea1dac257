"""Connected components of an edge table, by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitwatch.llm import common


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (u, v: long): root is its component's smallest node.

    Self links only make their node known; an empty table gives an empty table. Each round's edges are a
    table in the shared folder, and no node's neighbours are ever gathered: stars are built by joins with
    each node's minimum, which adaptive execution splits when a node is hot.
    """
    loops = edges.filter("u = v").select(F.col("u").alias("node"))
    links = edges.filter("u <> v").select("u", "v")
    now = common.Stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _mark(now.df)
    for _ in range(most_rounds):
        new = common.Stored(_small(_large(now.df)), "edges")
        now.discard()
        now, mark = new, _mark(new.df)
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    roots = now.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct()).union(loops.join(roots, "node", "left_anti").join(roots.select(F.col("root").alias("node")), "node", "left_anti").select("node", F.col("node").alias("root")).distinct())
