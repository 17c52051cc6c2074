"""Connected components by rounds of joins; labels never come to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component``: the least node id reachable over links ``a, b``; nodes without links are not listed.

    Each round every node takes the least label around it, and labels then follow their own label (pointer jumping), so that
    long chains take few rounds. The state of every round is written to the shared folder. ``rounds`` only guards against running on: a
    graph that is not done by then raises an error.
    """
    edges = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    state = staged(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    for _ in range(rounds):
        around = edges.join(state, edges["b"] == state["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = state.join(around, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = lower.select(F.col("node").alias("at"), F.col("next").alias("onward"))
        after = staged(lower.join(jump, lower["next"] == jump["at"], "left").select(
            "node", F.col("label").alias("old"), F.least("next", F.coalesce("onward", "next")).alias("label")), "labels")
        state = after.select("node", "label")
        if not after.where("old <> label").limit(1).count():
            return state.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components are not done after {rounds} rounds")
