"""Connected components as a loop of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.session import anew, cut


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """node, component of every node of ``edges`` (a, b): component is the smallest node it is connected with.

    Each round lets a node take the smallest label of its neighbours and then the label of that label, so the
    rounds grow with the logarithm of the longest chain. Labels are minima with map-side aggregation; a node
    with very many edges is no bottleneck. Null ends are no edges; loops and repeated edges are harmless. Every
    round is cut to the shared checkpoint folder. Raises if ``max_rounds`` did not suffice.
    """
    pairs = edges.select("a", "b").where("a is not null and b is not null")
    both = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    for _ in range(max_rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("low"))
        of = labels.select(F.col("node").alias("low"), F.col("label").alias("lower"))
        renewed = anew(cut(nearer.join(of, "low").select("node", F.least("low", "lower").alias("low"), (F.least("low", "lower") != F.col("label")).alias("moved"))))
        labels = renewed.select("node", F.col("low").alias("label"))
        if renewed.where("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
