"""Connected components of a link table, by contraction; nothing but a row count reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import stored


def connected_components(links: DataFrame, label: str = "components") -> DataFrame:
    """``node`` and ``component`` (the smallest node that it reaches) for every node of ``links``.

    ``links`` has the columns ``lo`` and ``hi``; order, repeats and loops do not matter. In each
    round every node moves to its smallest neighbour and the links are drawn anew between what is
    left. The smallest node of a component never moves, and any other one moves in the end, so the
    rounds stop when no link is left; their number grows with the logarithm of the longest path.
    A node with very many links costs one partial minimum a task.
    """
    links = links.select("lo", "hi").where("lo <> hi")
    labels = None
    while True:
        both = links.unionByName(links.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        moves = stored(both.groupBy(F.col("lo").alias("node")).agg(F.least(F.first("lo"), F.min("hi")).alias("to")), f"{label}-moves")
        if labels is None:
            labels = moves.select("node", F.col("to").alias("component"))
        else:
            moved = moves.select(F.col("node").alias("component"), "to")
            labels = labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = stored(labels, f"{label}-labels")
        left = links.join(moves.select(F.col("node").alias("lo"), F.col("to").alias("a")), "lo").join(moves.select(F.col("node").alias("hi"), F.col("to").alias("b")), "hi")
        links = stored(left.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), f"{label}-links")
        if links.isEmpty():
            return labels
