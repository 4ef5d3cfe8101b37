"""Connected components by minimum labels and pointer jumping, on frames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import dropped, staged


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. Returns node, label (the smallest node of its component), a row for each node of an edge.

    A round takes the smallest label among a node and its neighbours, then the label of that label's node, so a
    chain's length about halves at least each round. Minima are combined before the shuffle; each round is a written
    table. Rounds end when no label changes. No edges give no rows; an edge from a node to itself is a node."""
    own = staged(edges.select("a", "b"))
    both = staged(own.union(own.select("b", "a")).distinct())
    dropped(own)
    state = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        told = both.join(state, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("told"))
        nearer = state.join(told, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "told").alias("near"))
        jump = state.select(F.col("node").alias("_n"), F.col("label").alias("far"))
        new = staged(nearer.join(jump, F.col("near") == F.col("_n"), "left").select("node", "old", F.least("near", "far").alias("label")))
        dropped(state)
        state = new
        if not new.filter("old <> label").limit(1).count():
            dropped(both)
            return state.select("node", "label")
