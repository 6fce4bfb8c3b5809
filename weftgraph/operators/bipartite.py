"""Bipartite graphs: vertices, statistics, degree distributions, GraphML text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.expressions import average_degree
from weftgraph.operators.components import connected_components
from weftgraph.operators.contracts import unique

TAIL = "  </graph>\n</graphml>"


def head(left: str, right: str) -> str:
    """The start of the file: a key for the type of a node, one for the id of a left and one for that of a right node."""
    keys = [("d0", "type"), ("d1", left), ("d2", right)]
    lines = [f'  <key id="{k}" for="node" attr.name="{_escaped(name)}" attr.type="string"/>' for k, name in keys]
    return "\n".join(['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *lines, '  <graph edgedefault="undirected">'])


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def escaped(c: Column) -> Column:
    """A value as it stands in XML; what XML 1.0 can't hold becomes U+FFFD."""
    c = F.regexp_replace(c.cast("string"), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "\ufffd")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


def unescaped(c: Column) -> Column:
    for mark, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(name), F.lit(mark))
    return c


def degree_rows(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(side, id, degree)."""
    one = lambda side, c: pairs.groupBy(F.col(c).cast("string").alias("id")).agg(F.count("*").alias("degree")).select(F.lit(side).alias("side"), "id", "degree")
    return one("left", left).unionAll(one("right", right))


def stats(pairs: DataFrame, left: str, right: str) -> DataFrame:
    rows = pairs.agg(F.count("*").alias("n_edges"), F.countDistinct(left).alias("n_left"), F.countDistinct(right).alias("n_right"))
    n = F.col("n_left") + F.col("n_right")
    return rows.select("n_left", "n_right", n.alias("n_nodes"), "n_edges", average_degree(n, F.col("n_edges")).alias("avg_degree"))


def degree_distribution(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(side, degree, n), side `all` included."""
    per_side = degree_rows(pairs, left, right).groupBy("side", "degree").agg(F.count("*").alias("n"))
    return per_side.unionByName(per_side.groupBy("degree").agg(F.sum("n").alias("n")).select(F.lit("all").alias("side"), "degree", "n"))


def component_sizes(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(size, n_components); ids of the two sides are kept apart by parity."""
    edges = pairs.select((F.col(left) * 2).alias("src"), (F.col(right) * 2 + 1).alias("dst"))
    nodes = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id"))).distinct()
    sizes = connected_components(nodes, edges).groupBy("component").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("n_components"))


def log_binned(distribution: DataFrame, bins: int = 23) -> DataFrame:
    """(bin, n) of positive degrees in logarithmic bins from the least to the largest, which is in the last; one bin where they are equal."""
    rows = distribution.where("degree > 0")
    span = rows.agg(F.min("degree").alias("_lo"), F.max("degree").alias("_hi"))
    at = F.try_divide(F.ln(F.col("degree") / F.col("_lo")) * bins, F.ln(F.col("_hi") / F.col("_lo")))
    at = F.least(F.coalesce(F.floor(at), F.lit(0)), F.lit(bins - 1))
    return rows.crossJoin(F.broadcast(span)).groupBy(at.cast("int").alias("bin")).agg(F.sum("n").alias("n"))


def reject_duplicates(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """`pairs`, if none is repeated; a bipartite graph has an edge once."""
    return unique(pairs, left, right)


def graphml_lines(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(section, line) of a GraphML file: 1 left nodes, 2 right nodes, 3 edges. Write in order of both columns."""

    def node(c: str, key: str) -> DataFrame:
        value = escaped(F.col(c))
        line = F.concat(F.lit(f'    <node id="{c}:'), value, F.lit(f'"><data key="d0">{c}</data><data key="{key}">'), value, F.lit("</data></node>"))
        return pairs.select(F.col(c)).distinct().select(line.alias("line"))

    edge = F.concat(F.lit(f'    <edge source="{left}:'), escaped(F.col(left)), F.lit(f'" target="{right}:'), escaped(F.col(right)), F.lit('"/>'))
    parts = [node(left, "d1"), node(right, "d2"), pairs.select(edge.alias("line"))]
    rows = [part.select(F.lit(i).alias("section"), "line") for i, part in enumerate(parts, 1)]
    return rows[0].unionAll(rows[1]).unionAll(rows[2])


def graphml_size(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Bytes of the file, before it is written."""
    around = len(head(left, right).encode()) + len(TAIL.encode()) + 2
    return graphml_lines(pairs, left, right).agg((F.coalesce(F.sum(F.octet_length("line") + 1), F.lit(0)) + around).alias("n_bytes"))
