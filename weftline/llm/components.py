"""Connected components of an undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import Cut


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, comp)`` of every node of the edges ``(a, b)``; ``comp`` is the smallest node of the component.

    Each round takes the smallest label of a node's neighbours, then the label of that label, so that the rounds
    grow with the logarithm of the longest path; the tables of a round are written to the shared folder. Null ends
    and loops are ignored; repeated edges count once.
    """
    cut = Cut(edges.sparkSession, "comp")
    ok = edges.where("a is not null and b is not null and a <> b")
    both = cut.keep(ok.select("a", "b").unionByName(ok.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        lower = labels.join(near, "node").select("node", F.least("label", "low").alias("low"), F.col("label").alias("old"))
        held = cut.keep(lower)
        ahead = held.select(F.col("node").alias("low"), F.col("low").alias("next"))
        moved = cut.keep(held.join(ahead, "low").select("node", F.col("next").alias("label"), (F.col("next") != F.col("old")).alias("moved")))
        cut.drop(held)
        if not moved.where("moved").limit(1).count():
            return moved.select("node", F.col("label").alias("comp"))
        labels = moved.drop("moved")
