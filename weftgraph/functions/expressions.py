"""Scalar expressions shared by the operators. Rounding is done on integers, so that it is the same everywhere."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space, Unicode's included, at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def ratio(part: Column, whole: Column, digits: int) -> Column:
    """part / whole of non-negative integers, half up at `digits` decimals; null where whole is 0."""
    scale = 10**digits
    a, b = part.cast("long"), F.nullif(whole.cast("long"), F.lit(0).cast("long"))
    return F.call_function("div", 2 * a * scale + b, 2 * b) / F.lit(float(scale))


def jaccard(shared: Column, left: Column, right: Column) -> Column:
    return ratio(shared, left + right - shared, 6)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, 0 where whole is 0."""
    return F.coalesce(ratio(part.cast("long") * 100, whole, digits), F.lit(0.0))


def average_degree(nodes: Column, edges: Column) -> Column:
    return F.coalesce(ratio(edges.cast("long") * 2, nodes, 4), F.lit(0.0))


def density(nodes: Column, edges: Column) -> Column:
    n = nodes.cast("long")
    return F.coalesce(ratio(edges.cast("long") * 2, n * (n - 1), 8), F.lit(0.0))


def choose2(n: Column) -> Column:
    n = n.cast("long")
    return F.call_function("div", n * (n - 1), F.lit(2).cast("long"))


#: What reads as a decimal number, exponents and the names of the special values included.
NUMBER = r"^[+-]?((\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?|(?i:inf|infinity|nan))$"


def value_type(c: Column) -> Column:
    """bool, date, int, float or string, by the look of a raw value without white space around it; null where there is none."""
    s = strip(c)
    return (
        F.when(c.isNull() | (s == ""), "null")
        .when(F.lower(s).isin("true", "false"), "bool")
        .when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), "date")
        .when(s.rlike(r"^-?\d+$"), "int")
        .when(s.rlike(NUMBER), "float")
        .otherwise("string")
    )


def merged_type(kinds: Column) -> Column:
    """The type of a column from the array of its values' types: one that all share, float for int and float, else string; null for no value."""
    real = F.array_sort(F.array_remove(F.array_distinct(kinds), "null"))
    return F.when(F.size(real) == 0, "null").when(F.size(real) == 1, F.get(real, F.lit(0))).when(real == F.array(F.lit("float"), F.lit("int")), "float").otherwise("string")


def correlation(x: Column, y: Column, digits: int = 6) -> Column:
    """Pearson correlation; null for empty or constant input."""
    constant = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    safe = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(constant, F.lit(None)).otherwise(F.round(safe, digits))


def log_edges(low: int, high: int, bins: int = 23) -> list[float]:
    """Edges of `bins` bins of equal width in the logarithm of positive values; the one bin [low, low + 1] where low and high are equal."""
    if low <= 0:
        raise ValueError("a logarithmic scale needs positive values")
    if low == high:
        return [float(low), low + 1.0]
    step = (math.log10(high) - math.log10(low)) / bins
    return [10 ** (math.log10(low) + i * step) for i in range(bins)] + [float(high)]


def parse_thresholds(raw: str) -> list[float]:
    """Distinct thresholds within [0, 1] from a comma-separated list, in order."""
    found = sorted({float(x) for x in raw.split(",") if x.strip()})
    if not found or found[0] < 0 or found[-1] > 1:
        raise ValueError("thresholds have to be a non-empty list within [0, 1]")
    return found
