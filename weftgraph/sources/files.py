"""Readers with explicit schemas and writers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.bipartite import TAIL, graphml_lines, graphml_size, head, reject_duplicates, unescaped
from weftgraph.operators.contracts import ContractError, exact_columns, holds, not_empty, required_columns
from weftgraph.operators.tags import TagConfig
from weftgraph.session import materialize


def read_csv(spark: SparkSession, path: str, schema: str | None = None, exact: bool = False) -> DataFrame:
    """CSV with a header; with `schema` malformed values fail, without one types are inferred."""
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    df = reader.option("mode", "FAILFAST").option("enforceSchema", False).schema(schema).csv(path)
    return exact_columns(df, *[f.name for f in df.schema]) if exact else df


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of items: absent tags become an empty array, an absent description an empty string; no rows, or a row without an id, fail."""
    df = spark.read.schema("app_id long, description string, tags array<string>").option("mode", "FAILFAST").json(path)
    holds(not_empty(df), F.col("app_id").isNotNull(), "an item without an id")
    return df.select("app_id", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def item_names(items: DataFrame) -> DataFrame:
    """(app_id, name) from a table with `name`, or else `title`."""
    column = "name" if "name" in items.columns else "title"
    required_columns(items, "app_id", column)
    return items.select("app_id", F.coalesce(F.trim(F.col(column)), F.col("app_id").cast("string")).alias("name"))


def write_csv(df: DataFrame, path: str, *order: str) -> None:
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).csv(path)


def write_checked_csv(df: DataFrame, path: str, *order: str) -> int:
    """`write_csv`, then the files are read back: columns, types and number of rows have to be those of `df`. Returns the rows."""
    rows = materialize(df)
    write_csv(rows, path, *order)
    back = read_csv(df.sparkSession, path, rows.schema.simpleString()[7:-1].replace(":", " "), exact=True)
    written, expected = back.count(), rows.count()
    if written != expected:
        raise ContractError(f"{written} rows were written of {expected}")
    return written


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document of statistics as one row."""
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_graphml_within(pairs: DataFrame, left: str, right: str, path: str, most_bytes: int = 1 << 30, force: bool = False, compression: str = "none") -> int:
    """`write_graphml` if the file has at most `most_bytes`, or by force; its size, before compression, is worked out before anything is written."""
    size = graphml_size(pairs, left, right).first()["n_bytes"]
    if size > most_bytes and not force:
        raise ContractError(f"the file would have {size} bytes, more than {most_bytes}")
    write_graphml(pairs, left, right, path, compression)
    return size


def write_graphml(pairs: DataFrame, left: str, right: str, path: str, compression: str = "none") -> None:
    """Text parts that, joined in order of their names, are one GraphML file (with `compression`, once unpacked); a repeated edge fails."""
    spark = pairs.sparkSession
    ends = spark.createDataFrame([(0, head(left, right)), (4, TAIL)], "section int, line string")
    lines = graphml_lines(reject_duplicates(pairs, left, right), left, right)
    lines.unionByName(ends).orderBy("section", "line").select("line").write.mode("overwrite").text(path, compression=compression)


def _xml_lines(spark: SparkSession, path: str, tag: str) -> DataFrame:
    text = spark.read.text(path)
    if text.isEmpty():
        raise ContractError(f"nothing in {path}")
    return text.select(F.explode(F.regexp_extract_all("value", F.lit(f"<{tag}\\s[^>]*>(?:(?!</?{tag}[\\s>]).)*"), F.lit(0))).alias("x"))


def _attribute(name: str):
    return unescaped(F.regexp_extract("x", name + r'\s*=\s*"([^"]*)"', 1))


def read_graphml_edges(spark: SparkSession, path: str) -> DataFrame:
    """(source, target) of the edges of a GraphML text, indented or not, whose tags don't cross lines; a file without any fails."""
    edges = _xml_lines(spark, path, "edge").select(_attribute("source").alias("source"), _attribute("target").alias("target"))
    return not_empty(edges)


def read_graphml_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(id, type, value) of the nodes: the value of key d0, and of whichever other key there is. A node and its data share a line."""
    data = F.regexp_extract_all("x", F.lit(r'<data key="d[1-9]"\s*>([^<]*)</data>'), F.lit(1))
    nodes = _xml_lines(spark, path, "node").select(_attribute("id").alias("id"), unescaped(F.regexp_extract("x", r'<data key="d0"\s*>([^<]*)</data>', 1)).alias("type"), unescaped(F.get(data, F.lit(0))).alias("value"))
    return not_empty(nodes)


def stats_json(row: DataFrame) -> str:
    """The one row of a statistics table as indented ASCII JSON."""
    return json.dumps(json.loads(row.select(F.to_json(F.struct("*"))).first()[0]), indent=2, ensure_ascii=True) + "\n"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header or JSON lines by the path's ending, else Parquet."""
    if path.endswith(".csv"):
        return read_csv(spark, path)
    return read_metadata(spark, path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)


def read_tag_config(spark: SparkSession, path: str) -> TagConfig:
    """Settings of the tag cleaning from one JSON document with TagConfig's names; unknown names fail."""
    found = json.loads("".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect()))
    return TagConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items()})
