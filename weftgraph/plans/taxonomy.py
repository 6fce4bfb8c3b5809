"""Reports of tags by category, and what to keep of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.contracts import same_set, unique


def classify(frequencies: DataFrame, taxonomy: DataFrame, check: bool = True) -> DataFrame:
    """(tag, freq, category_id, category) from (tag, freq) and (tag, category_id, category).

    With `check`, each observed tag has to be in the taxonomy once, and the taxonomy may hold no other.
    """
    if check:
        same_set(frequencies, unique(taxonomy, "tag"), "tag")
    return frequencies.select("tag", "freq").join(taxonomy.select("tag", "category_id", "category"), "tag")


def category_summary(classified: DataFrame) -> DataFrame:
    """Per category: tags and the sum of their frequencies."""
    return classified.groupBy("category_id", "category").agg(F.count("*").alias("n_tags"), F.sum("freq").alias("freq_total"))


def suggest(classified: DataFrame, core: Sequence[int], optional: Sequence[int], wanted: Sequence[str]) -> DataFrame:
    """Adds `suggestion`: `keep` in a core category, `keep_optional` for wanted tags of an optional one, `remove` for all else."""
    category = F.col("category_id")
    verdict = F.when(category.isin(*core), "keep").when(category.isin(*optional) & F.col("tag").isin(*wanted), "keep_optional").otherwise("remove")
    return classified.withColumn("suggestion", verdict)


def ordered(classified: DataFrame) -> DataFrame:
    """Adds `place`: by category, within it by falling frequency, then tag. Tags are few."""
    return classified.withColumn("place", F.row_number().over(Window.orderBy("category_id", F.desc("freq"), "tag")))
