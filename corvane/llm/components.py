"""Connected components of a link table, by rounds of minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corvane.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over (a, b) links, of any ordered type. Nodes without links are left out.

    Every round is three pre-aggregated group-bys and is written to the shared folder;
    rounds grow with the logarithm of the longest chain.
    """
    edges = cut(links.selectExpr("a as node", "b as other").union(links.selectExpr("b", "a")).distinct())
    labels = edges.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("root"))
    while True:
        labels = cut(labels)
        near = edges.join(labels.selectExpr("node as other", "root"), "other").groupBy("node").agg(F.min("root").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        jump = labels.selectExpr("node as root", "root as far")
        step = lower.join(jump, "root", "left").select("node", F.least("root", F.coalesce("far", "root")).alias("root"), "old")
        step = cut(step)
        if not step.where("root <> old").take(1):
            return step.select("node", "root")
        labels = step.select("node", "root")
