"""Connected components of a link table, without a driver or single-task step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import staged


def _settled(links: DataFrame) -> bool:
    """Whether ``links(a, b)``, each once and with ``a > b``, are stars around the smallest node of a component."""
    ends = F.array(
        F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))
    nodes = links.select(F.explode(ends).alias("end")).groupBy("end.node").agg(
        F.sum("end.up").alias("up"), F.count(F.lit(1)).alias("n"))
    return nodes.filter("up > 1 or up = 1 and n > 1").isEmpty()


def _stars(links: DataFrame, *, large: bool) -> DataFrame:
    """One round: every node hands its neighbours to its smallest neighbour.

    The large round hands over the larger neighbours only, the small round the
    smaller ones of links with ``a > b``; both keep the components as they are,
    and links with ``a > b``.
    """
    sides = links
    if large:
        both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        sides = links.select(F.explode(both).alias("side")).select("side.a", "side.b")
    lowest = sides.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
    joined = sides.join(lowest, "a")
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array("b", "a")).alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of ``links(a, b)``; the root is the smallest node.

    Links are rewritten by alternating star rounds until they are stars; each
    round is written to the shared folder, so no plan holds more than one.
    Loops and repeated links are allowed, an empty table gives an empty table.
    """
    once = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = staged(once, "links")
    while not _settled(now):
        for large in (True, False):
            now = staged(_stars(now, large=large), "links")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select("root", "root").distinct())
