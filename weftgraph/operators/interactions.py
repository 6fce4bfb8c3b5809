"""User-item interactions: cleaning, degree filters, stable core, funnels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.expressions import choose2, percent, ratio
from weftgraph.session import materialize


def dedupe(raw: DataFrame) -> DataFrame:
    """Distinct (user_id, app_id) without null keys."""
    return raw.select("user_id", "app_id").na.drop().dropDuplicates()


def user_degree_filter(pairs: DataFrame, low: int = 2, high: int = 30) -> DataFrame:
    """Pairs of users with `low` to `high` items; the degrees are combined map-side before their shuffle."""
    users = pairs.groupBy("user_id").count().where(F.col("count").between(low, high)).select("user_id")
    return pairs.join(users, "user_id", "left_semi")


def core_prune(pairs: DataFrame, min_user: int = 2, max_user: int = 30, min_item: int = 10) -> tuple[DataFrame, list[dict]]:
    """The largest part in which users have min_user or more items and items min_item or more users.

    The upper bound holds on base degrees, once. Rounds (items, then users) go on
    until neither removes an edge; the last, idle one is counted. A round writes its edges once, to the
    shared folder, and the counts by item; the driver sees three numbers a round.
    """
    edges = materialize(user_degree_filter(pairs, min_user, max_user))
    before = edges.count()
    rounds = []
    while True:
        counts = materialize(edges.groupBy("app_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_item))
        after_items = counts.agg(F.sum("n")).first()[0] or 0
        by_item = edges if after_items == before else edges.join(counts.select("app_id"), "app_id", "left_semi")
        by_user = materialize(_at_least(by_item, "user_id", min_user))
        after = by_user.count()
        rounds.append({"round": len(rounds) + 1, "removed_by_item": before - after_items, "removed_by_user": after_items - after, "n_edges": after})
        edges = by_user
        if after == before:
            return edges, rounds
        before = after


def _at_least(edges: DataFrame, key: str, low: int) -> DataFrame:
    good = edges.groupBy(key).count().where(F.col("count") >= low).select(key)
    return edges.join(good, key, "left_semi").select("user_id", "app_id")


def raw_counts(raw: DataFrame, *keys: str) -> DataFrame:
    """One row: raw rows, those with all keys, and distinct ones of these; one scan."""
    whole = raw.groupBy(*keys).agg(F.count("*").alias("n"))
    has = ~F.greatest(*[F.col(k).isNull() for k in keys])
    return whole.agg(F.sum("n").alias("n_rows"), F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_with_keys"), F.count_if(has).alias("n_distinct"))


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key in the order of an ingest index that differs within a key; combined on the map side."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    found = rows.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("_x"))
    return found.select(*keys, "_x.*").select(*rows.columns)


def stats(pairs: DataFrame) -> DataFrame:
    """One row: edges, users, items, averages, extremes and user-induced item pairs."""
    users = pairs.groupBy("user_id").agg(F.count("*").alias("n")).agg(
        F.sum("n").alias("n_edges"), F.count("*").alias("n_users"), F.min("n").alias("min_items_per_user"), F.max("n").alias("max_items_per_user"), F.sum(choose2(F.col("n"))).alias("user_induced_pairs")
    )
    items = pairs.groupBy("app_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_items"), F.min("n").alias("min_users_per_item"), F.max("n").alias("max_users_per_item"))
    both = users.crossJoin(F.broadcast(items))
    return both.withColumn("avg_items_per_user", ratio(F.col("n_edges"), F.col("n_users"), 4)).withColumn("avg_users_per_item", ratio(F.col("n_edges"), F.col("n_items"), 4))


def funnel(stages: dict[str, DataFrame]) -> DataFrame:
    """Per stage, in order of their names: users, items and edges, and the share of the first stage's edges."""
    rows = None
    for name, pairs in stages.items():
        one = pairs.agg(F.lit(name).alias("stage"), F.countDistinct("user_id").alias("n_users"), F.countDistinct("app_id").alias("n_items"), F.count("*").alias("n_edges"))
        rows = one if rows is None else rows.unionByName(one)
    # A row a stage: the window sees no more than these.
    base = F.first("n_edges").over(Window.orderBy("stage"))
    return rows.withColumn("pct_edges", percent(F.col("n_edges"), base))


def sensitivity_grid(pairs: DataFrame, max_users: list[int], min_items: list[int]) -> DataFrame:
    """Sizes for each (max_user, min_item): users by base degree, then one pass over items, without iteration.

    One job: edges meet the upper bounds that they satisfy, and items are counted for each bound.
    """
    degree = pairs.groupBy("user_id").agg(F.count("*").alias("deg")).where("deg >= 2")
    bounds = F.filter(F.array(*[F.lit(x) for x in max_users]), lambda b: b >= F.col("deg"))
    edges = pairs.join(degree, "user_id").select("user_id", "app_id", F.explode(bounds).alias("max_user"))
    counts = edges.groupBy("max_user", "app_id").agg(F.count("*").alias("n"))
    floors = F.filter(F.array(*[F.lit(x) for x in min_items]), lambda b: b <= F.col("n"))
    alive = edges.join(counts, ["max_user", "app_id"]).select("user_id", "app_id", "max_user", F.explode(floors).alias("min_item"))
    per_user = alive.groupBy("max_user", "min_item", "user_id").agg(F.count("*").alias("n")).groupBy("max_user", "min_item").agg(F.count("*").alias("n_users"), F.sum("n").alias("n_edges"))
    per_item = counts.select("max_user", F.explode(floors).alias("min_item")).groupBy("max_user", "min_item").agg(F.count("*").alias("n_items"))
    base = pairs.agg(F.count("*").alias("_base"))
    rows = per_user.join(per_item, ["max_user", "min_item"]).crossJoin(F.broadcast(base))
    return rows.select("max_user", "min_item", "n_users", "n_items", "n_edges", percent(F.col("n_edges"), F.col("_base")).alias("pct_edges"))
