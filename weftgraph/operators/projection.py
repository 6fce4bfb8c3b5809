"""One-mode projections with Jaccard weights, thresholds, sweeps and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.expressions import average_degree, choose2, density, jaccard, percent, ratio
from weftgraph.operators.components import connected_components
from weftgraph.session import materialize


def estimate(pairs: DataFrame, hub: str = "user_id") -> DataFrame:
    """Rows that the pair join would make, before it runs."""
    degrees = pairs.groupBy(hub).agg(F.count("*").alias("n"))
    return degrees.agg(F.sum(choose2(F.col("n"))).alias("raw_pair_incidences"), F.count("*").alias("n_hubs"), F.max("n").alias("max_degree"))


def guard(pairs: DataFrame, hub: str, most: int) -> None:
    found = estimate(pairs, hub).first()["raw_pair_incidences"] or 0
    if found > most:
        raise ValueError(f"the projection would make {found} pairs, more than {most}")


def count_pairs(pairs: DataFrame, hub: str = "user_id", item: str = "app_id") -> DataFrame:
    """(src < dst, shared): hubs that two items share. The pair join and the partial counts run in one stage on hub; hot hubs are split by adaptive skew joins."""
    left = pairs.select(F.col(hub).alias("h"), F.col(item).alias("src"))
    right = pairs.select(F.col(hub).alias("h"), F.col(item).alias("dst"))
    return left.join(right, "h").where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("shared"))


def count_items(pairs: DataFrame, item: str = "app_id") -> DataFrame:
    """(id, n): hubs of each item, those with one item included."""
    return pairs.groupBy(F.col(item).alias("id")).agg(F.count("*").alias("n"))


def edges_from_counts(shared: DataFrame, counts: DataFrame) -> DataFrame:
    """(src, dst, shared, weight) from the counts of pairs and items."""
    rows = shared.join(counts.withColumnsRenamed({"id": "src", "n": "n_src"}), "src").join(counts.withColumnsRenamed({"id": "dst", "n": "n_dst"}), "dst")
    return rows.select("src", "dst", "shared", jaccard(F.col("shared"), F.col("n_src"), F.col("n_dst")).alias("weight"))


def joined_pairs(rows: DataFrame, hub: str, item: str, carried: list[str]) -> DataFrame:
    """(src < dst) once for each hub that two items share, with the `carried` columns of both ends as c_src and c_dst."""
    ends = [rows.select(F.col(hub).alias("h"), F.col(item).alias(end), *[F.col(c).alias(f"{c}_{end}") for c in carried]) for end in ("src", "dst")]
    return ends[0].join(ends[1], "h").where("src < dst")


def project_pairs(pairs: DataFrame, hub: str = "user_id", item: str = "app_id") -> DataFrame:
    """(src < dst, shared, weight): hubs two items share, and their Jaccard similarity. Items carry their counts into the pair join, so that edges, which are more, move once."""
    sized = pairs.join(count_items(pairs, item).withColumnsRenamed({"id": item, "n": "_n"}), item)
    rows = joined_pairs(sized, hub, item, ["_n"]).groupBy("src", "dst").agg(F.count("*").alias("shared"), F.max("_n_src").alias("_n_src"), F.max("_n_dst").alias("_n_dst"))
    return rows.select("src", "dst", "shared", jaccard(F.col("shared"), F.col("_n_src"), F.col("_n_dst")).alias("weight"))


def degrees(edges: DataFrame, universe: DataFrame) -> DataFrame:
    """(id, degree) for every id of the universe, 0 included."""
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))
    return universe.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def profile(edges: DataFrame, universe: DataFrame) -> DataFrame:
    """One row: nodes, edges, degrees, density, components, giant component, isolates, weights."""
    degree = degrees(edges, universe).agg(F.count("*").alias("n_nodes"), F.max("degree").alias("max_degree"), F.count_if(F.col("degree") == 0).alias("n_isolated"))
    sizes = connected_components(universe.select("id"), edges).groupBy("component").agg(F.count("*").alias("n"))
    parts = sizes.agg(F.count("*").alias("n_components"), F.max("n").alias("giant"))
    weights = edges.agg(F.count("*").alias("n_edges"), F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight"), F.sum(F.col("weight").cast("decimal(10,6)")).cast("double").alias("sum_weight"))
    rows = degree.crossJoin(F.broadcast(parts)).crossJoin(F.broadcast(weights))
    n, e = F.col("n_nodes"), F.col("n_edges")
    return rows.select("n_nodes", "n_edges", "max_degree", "n_isolated", "n_components", percent(F.col("giant"), n, 4).alias("giant_pct"), average_degree(n, e).alias("avg_degree"), density(n, e).alias("density"), "min_weight", "max_weight", F.round("sum_weight", 4).alias("sum_weight"))


def sweep(edges: DataFrame, universe: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per threshold: edges, isolated items, share of the edges at the lowest threshold.

    One scan: an edge is counted for the thresholds that its rounded weight reaches, an item by its heaviest edge.
    """
    reached = lambda c: F.explode(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: c >= t)).alias("threshold")
    counts = edges.select(reached(F.col("weight"))).groupBy("threshold").agg(F.count("*").alias("n_edges"))
    ends = edges.select(F.col("src").alias("id"), "weight").unionAll(edges.select(F.col("dst").alias("id"), "weight")).groupBy("id").agg(F.max("weight").alias("top"))
    touched = ends.select(reached(F.col("top"))).groupBy("threshold").agg(F.count("*").alias("touched"))
    n = universe.agg(F.count("*").alias("n_nodes"))
    lowest = edges.where(F.col("weight") >= thresholds[0]).agg(F.count("*").alias("base"))
    spark = edges.sparkSession
    rows = spark.createDataFrame([(float(t),) for t in thresholds], "threshold double").join(counts, "threshold", "left").join(touched, "threshold", "left").crossJoin(F.broadcast(n)).crossJoin(F.broadcast(lowest))
    e = F.coalesce("n_edges", F.lit(0))
    return rows.select("threshold", e.alias("n_edges"), (F.col("n_nodes") - F.coalesce("touched", F.lit(0))).alias("n_isolated"), percent(e, F.greatest("base", F.lit(1)), 4).alias("retained_pct"), average_degree(F.col("n_nodes"), e).alias("avg_degree"))


def threshold_counts(edges: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, n_edges) in one scan."""
    one = edges.agg(*[F.count_if(F.col("weight") >= t).alias(f"t{i}") for i, t in enumerate(thresholds)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("n_edges")) for i, t in enumerate(thresholds)])).alias("x")).select("x.*")


def labelled_sweep(series: dict[str, DataFrame]) -> DataFrame:
    """(projection, threshold, n_edges, retained_pct): the counts of several projections, each beside its own largest."""
    rows = None
    for name, counts in series.items():
        one = counts.select(F.lit(name).alias("projection"), "threshold", "n_edges")
        rows = one if rows is None else rows.unionByName(one)
    most = F.max("n_edges").over(Window.partitionBy("projection"))
    return rows.withColumn("retained_pct", percent(F.col("n_edges"), most, 4))


def component_sweep(edges: DataFrame, universe: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per threshold: components, size of the largest, components of one item.

    From the highest threshold down, the components found so far are the vertices of the next
    level, which only adds the edges between the two thresholds: each edge is used once in all.
    """
    labels = universe.select("id", F.col("id").alias("component"))
    out, above = None, None
    for threshold in sorted(set(thresholds), reverse=True):
        band = edges.where(F.col("weight") >= threshold)
        band = band if above is None else band.where(F.col("weight") < above)
        ends = band.select("src", "dst").join(labels.withColumnsRenamed({"id": "src", "component": "a"}), "src").join(labels.withColumnsRenamed({"id": "dst", "component": "b"}), "dst")
        links = ends.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
        merged = connected_components(labels.select(F.col("component").alias("id")).distinct(), links).withColumnsRenamed({"id": "_was", "component": "_now"})
        labels = materialize(labels.join(merged, F.col("component") == F.col("_was")).select("id", F.col("_now").alias("component")))
        sizes = labels.groupBy("component").agg(F.count("*").alias("n"))
        row = sizes.agg(F.lit(float(threshold)).alias("threshold"), F.count("*").alias("n_components"), F.max("n").alias("giant"), F.count_if(F.col("n") == 1).alias("n_single"))
        out = row if out is None else out.unionByName(row)
        above = threshold
    if out is None:
        raise ValueError("no thresholds")
    return out


def weight_stats(edges: DataFrame) -> DataFrame:
    """One row: nodes with an edge, edges, degree, and least, largest and mean weight (on millionths, so that order doesn't matter)."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).agg(F.countDistinct("id").alias("n_nodes"))
    millionths = F.round(F.col("weight") * 1_000_000).cast("long")
    rows = edges.agg(F.count("*").alias("n_edges"), F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight"), F.sum(millionths).alias("_s")).crossJoin(F.broadcast(nodes))
    return rows.select("n_nodes", "n_edges", average_degree(F.col("n_nodes"), F.col("n_edges")).alias("avg_degree"), "min_weight", "max_weight", (ratio(F.col("_s"), F.col("n_edges"), 0) / 1_000_000.0).alias("avg_weight"))


def threshold_filter(edges: DataFrame, threshold: float) -> DataFrame:
    """Edges whose rounded weight reaches the threshold, with every column."""
    return edges.where(F.col("weight") >= threshold)
