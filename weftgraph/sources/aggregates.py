"""A store of a projection's aggregates, from which edges are made again without the pair join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.operators.contracts import ContractError
from weftgraph.operators.projection import count_items, count_pairs, edges_from_counts

PARTS = {"pairs": ("src", "dst", "shared"), "items": ("id", "n")}


def save(pairs: DataFrame, path: str, hub: str = "user_id", item: str = "app_id") -> None:
    """Writes the pair counts and item counts of `pairs` below `path`; a store that is there fails."""
    count_pairs(pairs, hub, item).write.parquet(f"{path}/pairs")
    count_items(pairs, item).write.parquet(f"{path}/items")


def reopen(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The pair counts and item counts of a store; other columns than a store's are refused."""
    found = {}
    for part, columns in PARTS.items():
        found[part] = spark.read.parquet(f"{path}/{part}")
        if tuple(found[part].columns) != columns:
            raise ContractError(f"{path}/{part} has the columns {found[part].columns}, expected {list(columns)}")
    return found["pairs"], found["items"]


def edges(spark: SparkSession, *paths: str) -> DataFrame:
    """The edges of one store, or of several over disjoint hubs, whose counts add up."""
    if not paths:
        raise ValueError("no store")
    stores = [reopen(spark, p) for p in paths]
    pairs, items = stores[0]
    for more_pairs, more_items in stores[1:]:
        pairs, items = pairs.unionByName(more_pairs), items.unionByName(more_items)
    if len(stores) > 1:
        pairs = pairs.groupBy("src", "dst").agg({"shared": "sum"}).withColumnRenamed("sum(shared)", "shared")
        items = items.groupBy("id").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    return edges_from_counts(pairs, items)


def delete(spark: SparkSession, path: str) -> bool:
    """Deletes the store's two tables, wherever Hadoop's file systems keep them, and its folder if nothing else is in it."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = [fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{part}"), True) for part in PARTS]
    if fs.exists(root) and not fs.listStatus(root):
        fs.delete(root, False)
    return all(gone)
