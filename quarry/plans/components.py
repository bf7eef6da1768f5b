"""Connected components of an edge table by minimum labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.lineage import materialize, release


def components(edges: DataFrame, a: str = "u", b: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, comp): the smallest node of each node's component; only nodes with an edge.

    Each round takes the smallest label among a node and its neighbours, a partial aggregate,
    then jumps to that label's own label, so the rounds grow with the logarithm of a chain.
    Each round is written as a table; nothing but a count of changes reaches the driver."""
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = materialize(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x <> y").distinct(), "links")
    labels = materialize(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("node")).alias("comp")), "labels")
    held = labels  # the table behind ``labels``
    for _ in range(max_rounds):
        seen = both.join(labels.select(F.col("node").alias("y"), "comp"), "y").groupBy(F.col("x").alias("node")).agg(F.min("comp").alias("least"))
        low = labels.join(seen, "node").select("node", F.col("comp").alias("was"), F.least("comp", "least").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        new = low.join(jump, "comp", "left").select("node", "was", F.least("comp", F.coalesce("further", "comp")).alias("comp"))
        new = materialize(new, "labels")
        release(held)
        held, labels = new, new.select("node", "comp")
        if not new.where("comp <> was").limit(1).count():
            release(both)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
