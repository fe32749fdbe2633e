"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component of every node in a link; the component is its smallest node.

    Each round every node takes the smallest node it is linked to, then that node's own,
    and the links are rewritten to what their ends took. What was taken stays linked
    on, so nothing is lost, and links whose ends agree go. The rounds grow with the
    logarithm of the longest path. Every round is written to the shared folder. Links of
    one node are reduced to a row per task before the shuffle; the joins are plain sort-merge
    joins, whose hot keys adaptive execution splits. Null ends are left out.
    """
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    rounds: list[DataFrame] = []
    first = True
    while first or not edges.isEmpty():
        first = False
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("low"))
        near = written(near, "near")
        on = near.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        step = written(near.join(on, "low").select("node", F.col("lower").alias("label")), "labels")
        rounds.append(step)

        def taken(node: str, to: str) -> DataFrame:
            return step.select(F.col("node").alias(node), F.col("label").alias(to))

        moved = edges.join(taken("a", "x"), "a").join(taken("b", "y"), "b").select("x", "y")
        # A label that has taken a smaller one itself stays linked to it.
        chained = taken("label", "label2").join(step.select("label").distinct(), "label")
        chained = chained.select(F.col("label").alias("x"), F.col("label2").alias("y"))
        rest = moved.unionByName(chained).where("x != y")
        edges = written(rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    result = rounds[-1].select("node", F.col("label").alias("component"))
    for step in reversed(rounds[:-1]):
        later = result.select(F.col("node").alias("label"), "component")
        result = step.join(later, "label", "left").select(
            "node", F.coalesce("component", "label").alias("component")
        )
        result = written(result, "components")
    return result
