"""Profiles of raw tables: nulls, types, buckets, nearest-rank percentiles, overlaps of id sets, bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DateType, MapType, StructType

from weftgraph.functions.expressions import choose2, merged_type, value_type


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: rows, nulls or blanks, distinct values, and the type that all its values share.

    Strings are typed by their look, value by value; arrays are `list`, structs and maps `dict`, and what the schema types keeps its type.
    """
    rows, typed = [], {}
    for f in df.schema:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        nested = isinstance(f.dataType, ArrayType | StructType | MapType)
        typed[f.name] = "list" if isinstance(f.dataType, ArrayType) else "dict" if nested else "bool" if isinstance(f.dataType, BooleanType) else "date" if isinstance(f.dataType, DateType) else None
        rows.append(F.struct(F.lit(f.name).alias("column"), (F.to_json(c) if nested else c.cast("string")).alias("v")))
    long = df.select(F.explode(F.array(*rows)).alias("x")).select("x.column", "x.v")
    # Distinct values by two combined aggregations instead of one row for each value in memory.
    cells = long.groupBy("column", "v").agg(F.count("*").alias("n"))
    known = F.create_map(*[x for name, kind in typed.items() for x in (F.lit(name), F.lit(kind).cast("string"))])
    kind = value_type(F.col("v"))
    kind = F.when(kind == "null", kind).otherwise(F.coalesce(F.element_at(known, F.col("column")), kind))
    found = cells.withColumn("kind", kind).groupBy("column").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("kind") == "null", F.col("n")).otherwise(0)).alias("n_null"), F.count("v").alias("n_distinct"), F.collect_set("kind").alias("kinds"))
    return found.select("column", "n_rows", "n_null", "n_distinct", merged_type(F.col("kinds")).alias("value_type"))


def degree_buckets(pairs: DataFrame, key: str) -> DataFrame:
    n = F.col("n")
    rows = pairs.groupBy(key).agg(F.count("*").alias("n"))
    return rows.agg(*[F.count_if(c).alias(name) for name, c in (("eq_1", n == 1), ("le_5", n <= 5), ("le_10", n <= 10), ("ge_100", n >= 100), ("ge_1k", n >= 1_000), ("ge_10k", n >= 10_000))])


def nearest_rank(pairs: DataFrame, key: str, at: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Percentiles of the counts by key that are values which occur."""
    ordered = [F.expr(f"percentile_disc({a}) WITHIN GROUP (ORDER BY n)").cast("long").alias(f"p{round(a * 100)}") for a in at]
    return pairs.groupBy(key).agg(F.count("*").alias("n")).agg(*ordered)


def set_overlap(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """Per combination of sets, the ids that are in exactly these: (in_<name>..., n). One shuffle, whatever the number of sets."""
    rows = None
    for name, df in sets.items():
        one = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), *[F.lit(other == name).alias(f"in_{other}") for other in sets])
        rows = one if rows is None else rows.unionByName(one)
    flags = [f"in_{name}" for name in sets]
    return rows.groupBy("id").agg(*[F.bool_or(f).alias(f) for f in flags]).groupBy(*flags).agg(F.count("*").alias("n"))


def size_buckets(items: DataFrame, column: str) -> DataFrame:
    """How many arrays hold 0, 1-2, 3-5, 6-10 or more entries; null arrays aren't counted."""
    n = F.size(column)
    cases = (("n_0", n == 0), ("n_1_2", n.between(1, 2)), ("n_3_5", n.between(3, 5)), ("n_6_10", n.between(6, 10)), ("n_gt_10", n > 10))
    return items.where(F.col(column).isNotNull()).agg(*[F.count_if(c).alias(name) for name, c in cases])


def bounds(pairs: DataFrame, user: str = "user_id", item: str = "app_id") -> DataFrame:
    """Upper bounds of a projection on items: all pairs of items, and the pairs that users induce."""
    users = pairs.groupBy(user).agg(F.count("*").alias("n")).agg(F.sum(choose2(F.col("n"))).alias("user_induced_pairs"))
    items = pairs.agg(F.countDistinct(item).alias("n_items"))
    return items.crossJoin(F.broadcast(users)).select("n_items", choose2(F.col("n_items")).alias("all_pairs"), "user_induced_pairs")


def first_records(rows: DataFrame, order: list[str], k: int = 3) -> DataFrame:
    """The first `k` rows in an order that tells them apart; a heap per partition, not a full sort."""
    return rows.orderBy(*order).limit(k)
