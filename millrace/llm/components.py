"""Connected components of a link table by distributed contraction (union-find on tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Return (node, root) for every node of ``links``; nodes share a root iff linked by a path.

    Each round every node points at the neighbour (or itself) whose hash, drawn anew
    each round, is least; links are rewritten to these and duplicates and loops go.
    A constant share of the nodes vanishes per round whatever the shape of the graph,
    so long chains need logarithmically many rounds. Minima are pre-aggregated before
    the shuffle, hence a node with a third of all links is no hot group. Rows with a
    null end, loops and repeated links have no effect; an empty table gives no rows.
    ``root`` is some node of the component, the same for all its nodes.
    """
    links = materialize(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "links")
    steps = []
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        turn = F.lit(len(steps))
        near = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", turn).alias("h"), "b")).alias("m"))
        self_h = F.struct(F.xxhash64("a", turn).alias("h"), F.col("a").alias("b"))
        step = materialize(near.select("a", F.least("m", self_h)["b"].alias("r")), "contract")
        steps.append(step)
        to_a, to_b = step.select(F.col("a"), F.col("r").alias("ra")), step.select(F.col("a").alias("b"), F.col("r").alias("rb"))
        moved = links.join(to_a, "a").join(to_b, "b").where("ra <> rb")
        left = materialize(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        discard(links)
        links = left
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # from the last round back, each round's targets are taken on to where later rounds took them; rounds shrink
    roots = steps[-1].select(F.col("a").alias("node"), F.col("r").alias("root"))
    for nth, step in enumerate(steps[-2::-1]):
        later = roots.select(F.col("node").alias("r"), "root")
        roots = step.join(later, "r", "left").select(F.col("a").alias("node"), F.coalesce("root", "r").alias("root"))
        if nth % 8 == 7:
            roots = materialize(roots, "roots")
    roots = materialize(roots, "roots")
    discard(links, *steps)
    return roots
