"""Comparing weighted graphs and partitions: overlap, correlation, quantiles, samples, ARI, NMI, modularity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.expressions import choose2, correlation, percent, ratio
from weftgraph.operators.ordering import numbered, running_total


def shared_edges(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("src", "dst", F.col("weight").alias("w_left")).join(right.select("src", "dst", F.col("weight").alias("w_right")), ["src", "dst"])


def edge_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Edges of both, shared and united, and their Jaccard similarity; one shuffle of both, by edge."""
    both = left.select("src", "dst", F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(right.select("src", "dst", F.lit(0).alias("l"), F.lit(1).alias("r")))
    pairs = both.groupBy("src", "dst").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    rows = pairs.agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"), F.sum(F.col("l") * F.col("r")).alias("n_shared"), F.count("*").alias("n_union"))
    return rows.withColumn("edge_jaccard", ratio(F.col("n_shared"), F.col("n_union"), 6))


def pearson(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), correlation(F.col(x), F.col(y)).alias("pearson"))


def average_ranks(rows: DataFrame, x: str, out: str) -> DataFrame:
    """Adds the mean rank among ties: distinct values are counted first, and the counts summed up over ranges of values."""
    counts = running_total(rows.groupBy(x).agg(F.count("*").alias("_n")), [x], "_n", "_less")
    return rows.join(counts.select(F.col(x), (F.col("_less") + (F.col("_n") + 1) / 2.0).alias(out)), x)


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    ranked = average_ranks(average_ranks(rows.select(x, y), x, "_rx"), y, "_ry")
    return ranked.agg(F.count("*").alias("n"), correlation(F.col("_rx"), F.col("_ry")).alias("spearman"))


def quantiles(rows: DataFrame, x: str, at: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9, 0.99)) -> DataFrame:
    """Linear-interpolated quantiles."""
    q = F.percentile(x, F.array(*[F.lit(a) for a in at]))
    names = ["q" + f"{a:g}".split(".")[1].ljust(2, "0") for a in at]
    return rows.agg(q.alias("q")).select(*[F.round(F.col("q")[i], 9).alias(n) for i, n in enumerate(names)])


def summary(rows: DataFrame, x: str) -> DataFrame:
    """n, least, largest, mean and quartiles of a column; zeros where it is empty."""
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    found = rows.agg(F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("avg"), q.alias("q"))
    values = [F.col("min"), F.col("max"), F.col("avg"), F.col("q")[0], F.col("q")[1], F.col("q")[2]]
    return found.select("n", *[F.coalesce(F.round(v, 6), F.lit(0.0)).alias(name) for v, name in zip(values, ("min", "max", "avg", "q25", "median", "q75"), strict=True)])


def reservoir(rows: DataFrame, order: list[str], value: str, k: int) -> DataFrame:
    """(slot, value) of the deterministic reservoir of size k: row number `seen` of the order goes to slot seen - 1, or beyond k to its hashed slot.

    The numbers come from one global order, as the definition asks, dealt by ranges; the last writer of a slot stays.
    """
    rows = numbered(rows.select(*order, F.col(value).alias("_value")), order, "seen").select(F.col("_value").alias("value"), "seen")
    # The constants of the linear congruential generator of the sampling rule.
    hashed = (F.col("seen") * 1103515245 + 12345).bitwiseAND(F.lit(0x7FFFFFFF)) % F.col("seen")
    slotted = rows.withColumn("slot", F.when(F.col("seen") <= k, F.col("seen") - 1).otherwise(hashed)).where(F.col("slot") < k)
    return slotted.groupBy("slot").agg(F.max_by("value", "seen").alias("value"))


def histogram(rows: DataFrame, x: str, bins: int = 50) -> DataFrame:
    """(bin from 0, count) of equal-width bins; the last one is closed on the right."""
    span = rows.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    at = F.least(F.floor((F.col(x) - F.col("lo")) * bins / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))), F.lit(bins - 1))
    return rows.crossJoin(F.broadcast(span)).groupBy(F.coalesce(at, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id", F.col("community").alias("ca")).join(b.select("id", F.col("community").alias("cb")), "id").groupBy("ca", "cb").agg(F.count("*").alias("n"))


def partition_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Adjusted Rand index and normalised mutual information (arithmetic mean) of two partitions (id, community)."""
    cells = contingency(a, b)
    rows, columns = (cells.groupBy(c).agg(F.sum("n").alias(f"n_{c}")) for c in ("ca", "cb"))
    total = cells.agg(F.sum("n").alias("total"))
    joint = cells.join(rows, "ca").join(columns, "cb").crossJoin(F.broadcast(total))
    t = F.col("total").cast("double")
    joint = joint.agg(F.sum(choose2(F.col("n"))).cast("double").alias("s"), F.sum(F.col("n") / t * F.log(F.col("n") * t / (F.col("n_ca") * F.col("n_cb").cast("double")))).alias("mi"), F.first("total").alias("total"))
    entropy = lambda d, c: d.crossJoin(F.broadcast(total)).agg(F.sum(choose2(F.col(c))).cast("double").alias(f"s_{c}"), (-F.sum(F.col(c) / t * F.log(F.col(c) / t))).alias(f"h_{c}"))
    out = joint.crossJoin(entropy(rows, "n_ca")).crossJoin(entropy(columns, "n_cb"))
    expected = F.try_divide(F.col("s_n_ca") * F.col("s_n_cb"), choose2(F.col("total")).cast("double"))
    middle = (F.col("s_n_ca") + F.col("s_n_cb")) / 2
    ari = F.coalesce(F.try_divide(F.col("s") - expected, middle - expected), F.lit(1.0))
    nmi = F.coalesce(F.try_divide(F.col("mi"), (F.col("h_n_ca") + F.col("h_n_cb")) / 2), F.lit(1.0))
    return out.select(F.round(ari, 6).alias("ari"), F.round(nmi, 6).alias("nmi"))


def modularity(edges: DataFrame, labels: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Weighted modularity of (id, community) over (src, dst, weight)."""
    src, dst = labels.withColumnsRenamed({"id": "src", "community": "cs"}), labels.withColumnsRenamed({"id": "dst", "community": "cd"})
    w = F.col("weight").cast("decimal(18,6)")
    rows = edges.join(src, "src").join(dst, "dst").select("cs", "cd", w.alias("w"))
    parts = rows.select(F.col("cs").alias("c"), F.when(F.col("cs") == F.col("cd"), F.col("w")).otherwise(0).alias("inner"), "w").unionAll(rows.select(F.col("cd").alias("c"), F.lit(0).cast("decimal(18,6)").alias("inner"), "w"))
    sums = parts.groupBy("c").agg(F.sum("inner").cast("double").alias("inside"), F.sum("w").cast("double").alias("deg"))
    total = edges.agg(F.sum(w).cast("double").alias("m"))
    value = F.sum(F.col("inside") / F.col("m") - gamma * (F.col("deg") / (2 * F.col("m"))) ** 2)
    return sums.crossJoin(F.broadcast(total)).agg(F.count("*").alias("n_communities"), F.round(value, 6).alias("modularity"))


def community_sizes(labels: DataFrame, k: int = 10) -> DataFrame:
    """The `k` largest communities: (place, community, size, pct of all nodes), by falling size, then community."""
    sizes = labels.groupBy("community").agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size").alias("_total"))
    first = sizes.orderBy(F.desc("size"), "community").limit(k)
    place = F.row_number().over(Window.orderBy(F.desc("size"), "community"))
    return first.crossJoin(F.broadcast(total)).select(place.alias("place"), "community", "size", percent(F.col("size"), F.col("_total"), 4).alias("pct"))


def assignments(labels: DataFrame, names: DataFrame) -> DataFrame:
    """(app_id, name, community_id, community_size) of (id, community); an item without a name is called by its id. Write in order of community_id and app_id."""
    sizes = labels.groupBy("community").agg(F.count("*").alias("community_size"))
    rows = labels.join(sizes, "community").join(names.select(F.col("app_id").alias("id"), "name"), "id", "left")
    return rows.select(F.col("id").alias("app_id"), F.coalesce("name", F.col("id").cast("string")).alias("name"), F.col("community").alias("community_id"), "community_size")
