"""Joins and components that stay even when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigraph.functions.lineage import cut, cut_round


def lookup(many: DataFrame, one: DataFrame, on: Sequence[str], hot: str) -> DataFrame:
    """Inner join of ``many`` with ``one``, which has one row per key and a boolean column ``hot``.

    Hot keys are those that hold more than a fixed part of ``many``'s rows, so their number is bounded; they are
    broadcast. All other keys meet by a shuffle in which no key is large.
    """
    few = F.broadcast(one.where(hot).drop(hot))
    rest = one.where(~F.col(hot)).drop(hot)
    on = list(on)
    return many.join(few, on).unionByName(many.join(few, on, "left_anti").join(rest, on))


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``edges``; a component is named by its least node.

    Each round every node takes the least label among its neighbours and then its label's own label, so the number
    of rounds grows with the logarithm of the longest path in practice. Labels are stored between rounds, without the
    planner's estimates of the rounds before.
    """
    both = cut(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).where("x <> y").distinct())
    labels = cut(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("component")))
    for _ in range(most_rounds):
        near = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("component").alias("m"))
        step = labels.join(near, labels["node"] == near["x"]).select("node", "component", F.least("component", "m").alias("next"))
        jump = labels.select(F.col("node").alias("__n"), F.col("component").alias("__c"))
        new = cut_round(step.join(jump, step["next"] == jump["__n"]).select("node", F.least("next", "__c").alias("component"), (F.least("next", "__c") < step["component"]).alias("moved")))
        labels = new.select("node", "component")
        if not new.where("moved").take(1):
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
