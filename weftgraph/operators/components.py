"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.session import materialize


def connected_components(vertices: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """`(id, component)` for each vertex, component being the smallest id reachable.

    `vertices` has `id`, `edges` has `src` and `dst`, in any direction, repeated or
    not; edges whose ends are no vertices must not occur. Each round hands every
    vertex the smallest label among its neighbours, then replaces each label by that
    label's own label, so the rounds grow with the logarithm of the longest path.
    State is written to the shared folder each round; the driver sees one count a round.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    both = materialize(both)
    labels = both.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("id"), F.least("src", "low").alias("label"))
    labels = materialize(labels)
    for _ in range(max_rounds):
        near = both.join(labels.withColumnsRenamed({"id": "dst", "label": "near"}), "dst").groupBy("src").agg(F.min("near").alias("near"))
        hooked = labels.join(near.withColumnRenamed("src", "id"), "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        hooked = materialize(hooked)
        own = hooked.select(F.col("id").alias("label"), F.col("label").alias("own"))
        jumped = hooked.join(own, "label").select("id", "old", F.least("label", "own").alias("label"))
        jumped = materialize(jumped)
        labels = jumped.select("id", "label")
        if jumped.where("label <> old").isEmpty():
            break
    else:
        raise RuntimeError(f"labels still change after {max_rounds} rounds")
    return vertices.join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("component"))
