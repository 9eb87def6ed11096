"""Connected components of an edge table, by joins and minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _edges(df: DataFrame) -> DataFrame:
    return df.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """id and component (its smallest reachable id) of every id in links (a, b: long).

    Each round hooks every root to its smallest neighbour, flattens the hooks by pointer jumping and contracts the
    edges, so rounds grow with the logarithm of the longest path. No step gathers a node's neighbours: a hub costs
    one row per task. The smallest id of a component never hooks, so it ends as the root.
    """
    edges = scratch.keep(_edges(links))
    label = edges.select(F.explode(F.array("hi", "lo")).alias("id")).distinct().select("id", F.col("id").alias("component"))
    while not edges.isEmpty():
        up = scratch.keep(edges.groupBy("hi").agg(F.min("lo").alias("to")))
        while True:
            over = up.select(F.col("hi").alias("to"), F.col("to").alias("far"))
            next_up = scratch.keep(up.join(over, "to", "left").select("hi", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")))
            scratch.drop(up)
            up = next_up.select("hi", "to")
            up._scratch_path = next_up._scratch_path
            if next_up.where("moved").isEmpty():
                break
        root = lambda c: up.select(F.col("hi").alias(c), F.col("to").alias(f"{c}_to"))
        label = scratch.keep(label.join(root("component"), "component", "left").select("id", F.coalesce("component_to", "component").alias("component")))
        moved = edges.join(root("hi"), "hi", "left").join(root("lo"), "lo", "left")
        rest = scratch.keep(_edges(moved.select(F.coalesce("hi_to", "hi").alias("a"), F.coalesce("lo_to", "lo").alias("b"))))
        scratch.drop(edges)
        edges = rest
    return scratch.keep(label)
