"""Integrity checks: each raises ContractError with what it found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ContractError(AssertionError):
    pass


def required_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return df


def exact_columns(df: DataFrame, *names: str) -> DataFrame:
    if df.columns != list(names):
        raise ContractError(f"columns are {df.columns}, expected {list(names)}")
    return df


def holds(df: DataFrame, condition: Column, what: str) -> DataFrame:
    """No row for which `condition` isn't true."""
    bad = df.where(~F.coalesce(condition, F.lit(False))).limit(1).collect()
    if bad:
        raise ContractError(f"{what}: {bad[0]}")
    return df


def unique(df: DataFrame, *keys: str) -> DataFrame:
    bad = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if bad:
        raise ContractError(f"repeated key: {bad[0]}")
    return df


def not_empty(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ContractError("no rows")
    return df


def contained(df: DataFrame, column: str, universe: DataFrame, key: str = "id") -> DataFrame:
    bad = df.select(F.col(column).alias(key)).join(universe.select(key), key, "left_anti").limit(1).collect()
    if bad:
        raise ContractError(f"{column} not in the universe: {bad[0]}")
    return df


def same_set(left: DataFrame, right: DataFrame, key: str) -> None:
    contained(left, key, right, key)
    contained(right, key, left, key)


def weighted_graph(edges: DataFrame, universe: DataFrame) -> DataFrame:
    """Weights in (0, 1], source before target (so no self loops), each pair once, ends inside the universe."""
    holds(edges, (F.col("weight") > 0) & (F.col("weight") <= 1), "weight outside (0, 1]")
    holds(edges, F.col("src") < F.col("dst"), "source not before target")
    unique(edges, "src", "dst")
    contained(edges, "src", universe)
    return contained(edges, "dst", universe)


def one_name(names: DataFrame, key: str = "app_id", name: str = "name") -> DataFrame:
    """No key with two different names; a missing name conflicts with none."""
    bad = names.groupBy(key).agg(F.min(name).alias("_lo"), F.max(name).alias("_hi")).where("_lo <> _hi").limit(1).collect()
    if bad:
        raise ContractError(f"conflicting names: {bad[0]}")
    return names


def bipartite(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Every edge of (source, target) leads from a node `left:...` to a node `right:...`."""
    return holds(edges, F.col("source").startswith(f"{left}:") & F.col("target").startswith(f"{right}:"), f"edge not from {left} to {right}")


def graph_violations(edges: DataFrame, universe: DataFrame) -> DataFrame:
    """(contract, n_bad) of the contracts of `weighted_graph`, counted instead of raised; repeated pairs count once each."""
    inside = universe.select(F.col("id").alias("_u")).distinct()
    rows = edges.join(inside, F.col("src") == F.col("_u"), "left").withColumnRenamed("_u", "_s").join(inside, F.col("dst") == F.col("_u"), "left")
    weight = F.col("weight")
    counts = {
        "weight_range": ~F.coalesce((weight > 0) & (weight <= 1), F.lit(False)),
        "self_loop": F.col("src") == F.col("dst"),
        "wrong_order": F.col("src") > F.col("dst"),
        "outside_universe": F.col("_s").isNull() | F.col("_u").isNull(),
    }
    one = rows.agg(*[F.count_if(c).alias(name) for name, c in counts.items()])
    again = edges.groupBy("src", "dst").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_pair"))
    both = one.crossJoin(F.broadcast(again))
    return both.select(F.explode(F.array(*[F.struct(F.lit(c).alias("contract"), F.col(c).alias("n_bad")) for c in (*counts, "repeated_pair")])).alias("x")).select("x.*")


def degree_violations(pairs: DataFrame, min_user: int, max_user: int, min_item: int) -> DataFrame:
    """One row: users whose items are out of bounds, items with too few users."""
    users = pairs.groupBy("user_id").agg(F.count("*").alias("n")).agg(F.count_if(~F.col("n").between(min_user, max_user)).alias("n_bad_users"))
    items = pairs.groupBy("app_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") < min_item).alias("n_bad_items"))
    return users.crossJoin(F.broadcast(items))


def final_degrees(pairs: DataFrame, min_user: int, max_user: int, min_item: int) -> DataFrame:
    bad = degree_violations(pairs, min_user, max_user, min_item).first()
    if bad["n_bad_users"] or bad["n_bad_items"]:
        raise ContractError(f"{bad['n_bad_users']} users and {bad['n_bad_items']} items are out of bounds")
    return pairs


def positive_union(rows: DataFrame, shared: str, left: str, right: str) -> DataFrame:
    """The union of two sets, from their sizes and what they share, has members in every row."""
    return holds(rows, F.col(left) + F.col(right) - F.col(shared) > 0, "empty union")


def repeats_of_the_row_before(rows: DataFrame, first: str, second: str) -> DataFrame:
    """One row: rows that, in order of both columns, equal the one before. Within a value of `first` only, so that no task sees all rows."""
    before = F.lag(second).over(Window.partitionBy(first).orderBy(second))
    return rows.select(before.eqNullSafe(F.col(second)).alias("_again")).agg(F.count("*").alias("n_rows"), F.count_if("_again").alias("n_repeated"))


def in_order(rows: DataFrame, first: str, second: str) -> DataFrame:
    """No row equals another in both columns; a table has no order of its own, so a strict order means just that."""
    if repeats_of_the_row_before(rows, first, second).first()["n_repeated"]:
        raise ContractError(f"repeated ({first}, {second})")
    return rows
