"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.base import settle


def components(edges: DataFrame) -> DataFrame:
    """Label every vertex of ``edges(a, b)`` with the smallest vertex it reaches.

    Each round maps every vertex to the smallest of itself and its neighbours,
    follows that map to its ends by pointer jumping, and contracts the links
    along it. A vertex that is not the smallest of its neighbourhood maps to a
    smaller one, so an end of the map is a local minimum, and no two of these
    are neighbours: at most half of the vertices that have links are left, on
    chains as well. A map of depth d takes log2(d) jumps. The smallest vertex of
    a component always maps to itself, so it is the one that remains. Rounds are
    written to the shared folder; nothing but a row count returns to the driver.
    A hub only enters as rows of a partial minimum or of a join that Spark may
    split.

    Returns ``vertex, component`` (long); vertices without a link to another
    vertex (self links, nulls) are absent.
    """
    links = settle(_clean(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))), "links")
    maps: list[DataFrame] = []
    while not links.isEmpty():
        both = links.select(F.col("a").alias("v"), F.col("b").alias("n")).union(links.select("b", "a"))
        step = _ends(settle(both.groupBy("v").agg(F.least(F.min("n"), F.first("v")).alias("to")), "hooks"))
        maps.append(step)
        left = step.select(F.col("v").alias("a"), F.col("to").alias("ta"))
        right = step.select(F.col("v").alias("b"), F.col("to").alias("tb"))
        links = settle(_clean(links.join(left, "a").join(right, "b").select(F.col("ta").alias("a"), F.col("tb").alias("b"))), "links")
    if not maps:
        return links.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    roots = maps[-1].select(F.col("v").alias("vertex"), F.col("to").alias("component"))
    for step in reversed(maps[:-1]):
        above = roots.select(F.col("vertex").alias("to"), "component")
        roots = step.join(above, "to", "left").select(F.col("v").alias("vertex"), F.coalesce("component", "to").alias("component"))
    return roots


def _ends(step: DataFrame) -> DataFrame:
    """``v, to`` with ``to`` followed until it maps to itself; every jump doubles the distance covered."""
    while True:
        further = step.where("v <> to").select(F.col("v").alias("to"), F.col("to").alias("end"))
        if step.join(further, "to", "left_semi").isEmpty():
            return step
        step = settle(step.join(further, "to", "left").select("v", F.coalesce("end", "to").alias("to")), "hooks")


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
