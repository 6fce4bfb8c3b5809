"""Item tags: explode, normalise, blacklist, frequency filters, reports."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.expressions import percent, ratio, strip
from weftgraph.operators.contracts import ContractError, contained, holds, unique


@dataclass(frozen=True)
class TagConfig:
    """Word lists are the user's; they are small and travel as literals."""

    min_freq: int = 50
    max_ratio: float = 0.15
    rename: dict[str, str] = field(default_factory=dict)
    blacklist: tuple[str, ...] = ()
    protected: tuple[str, ...] = ()


def explode_tags(items: DataFrame) -> DataFrame:
    """(app_id, tag) from (app_id, tags): stripped, without nulls and blanks, repeats kept."""
    rows = items.select("app_id", F.explode("tags").alias("tag")).select("app_id", strip(F.col("tag")).alias("tag"))
    return rows.where("tag IS NOT NULL AND tag <> ''")


def normalize(pairs: DataFrame, config: TagConfig) -> DataFrame:
    """Adds tag_original; renamed where the map says so. Repeats that renaming makes are kept."""
    if not config.rename:
        return pairs.withColumn("tag_original", F.col("tag"))
    mapping = F.create_map(*[F.lit(x) for kv in config.rename.items() for x in kv])
    return pairs.withColumn("tag_original", F.col("tag")).withColumn("tag", F.coalesce(F.try_element_at(mapping, F.col("tag")), "tag"))


def frequencies(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("tag").agg(F.count("*").alias("freq"))


def verdicts(pairs: DataFrame, config: TagConfig) -> DataFrame:
    """Per tag its frequency, and whether it is protected, too frequent or rare.

    The base is the distinct items after the blacklist; both filters look at the same frequencies.
    """
    kept = pairs.where(~F.col("tag").isin(*config.blacklist)) if config.blacklist else pairs
    n_items = kept.agg(F.countDistinct("app_id").alias("n_items"))
    rows = frequencies(kept).crossJoin(F.broadcast(n_items))
    protected = F.col("tag").isin(*config.protected) if config.protected else F.lit(False)
    return rows.withColumn("protected", protected).withColumn("too_frequent", ~protected & (F.col("freq") > F.col("n_items") * F.lit(config.max_ratio))).withColumn("rare", ~protected & (F.col("freq") < config.min_freq))


def clean(items: DataFrame, config: TagConfig) -> DataFrame:
    """Distinct (app_id, tag) that pass every filter."""
    pairs = normalize(explode_tags(items), config)
    good = verdicts(pairs, config).where("NOT too_frequent AND NOT rare").select("tag")
    return pairs.join(good, "tag", "left_semi").select("app_id", "tag").dropDuplicates()


def funnel(items: DataFrame, config: TagConfig) -> DataFrame:
    """Pairs, items and tags left after each stage."""
    raw = explode_tags(items)
    pairs = normalize(raw, config)
    kept = pairs.where(~F.col("tag").isin(*config.blacklist)) if config.blacklist else pairs
    stages = [("1_raw", raw), ("2_normalized", pairs), ("3_blacklist", kept), ("4_final", clean(items, config))]
    out = None
    for name, rows in stages:
        one = rows.agg(F.lit(name).alias("stage"), F.count("*").alias("n_pairs"), F.countDistinct("app_id").alias("n_items"), F.countDistinct("tag").alias("n_tags"))
        out = one if out is None else out.unionByName(one)
    return out.select("stage", "n_pairs", "n_items", "n_tags")


def stage_frequencies(items: DataFrame, config: TagConfig) -> DataFrame:
    """Per tag its frequency raw, after renaming and after all filters, repeats within an item counted; one scan, 0 where it doesn't occur."""
    pairs = normalize(explode_tags(items), config)
    good = verdicts(pairs, config).select("tag", (~F.col("too_frequent") & ~F.col("rare")).alias("final"))
    both = F.explode(F.array(F.struct(F.col("tag_original").alias("tag"), F.lit(1).alias("raw"), F.lit(0).alias("renamed")), F.struct(F.col("tag"), F.lit(0).alias("raw"), F.lit(1).alias("renamed")))).alias("x")
    counts = pairs.select(both).groupBy("x.tag").agg(F.sum("x.raw").alias("raw_freq"), F.sum("x.renamed").alias("normalized_freq"))
    final = F.when(F.col("final"), F.col("normalized_freq")).otherwise(0).alias("final_freq")
    return counts.join(good, "tag", "left").select("tag", "raw_freq", "normalized_freq", final)


def removed(pairs: DataFrame, config: TagConfig) -> DataFrame:
    """Tags that the frequency filters remove, why, and their share of the items."""
    rows = verdicts(pairs, config).where("too_frequent OR rare")
    reason = F.when(F.col("too_frequent"), "too_frequent").otherwise("rare").alias("reason")
    return rows.select("tag", "freq", ratio(F.col("freq"), F.col("n_items"), 4).alias("share"), reason)


def spared(pairs: DataFrame, config: TagConfig) -> DataFrame:
    """Protected tags that a frequency filter would have removed."""
    rows = verdicts(pairs, config).where("protected")
    return rows.where((F.col("freq") < config.min_freq) | (F.col("freq") > F.col("n_items") * F.lit(config.max_ratio))).select("tag", "freq")


def check_clean(items: DataFrame, config: TagConfig) -> DataFrame:
    """`clean`, after its invariants were checked.

    Frequencies add up to the pairs they were counted from, before and after renaming; final tags come from the renamed ones, once each; none is
    blacklisted, too frequent or rare; the frequencies of unprotected ones are within both bounds.
    """
    raw = explode_tags(items)
    pairs = normalize(raw, config)
    kept = clean(items, config)
    for rows in (raw, pairs):
        if (frequencies(rows).agg(F.sum("freq")).first()[0] or 0) != rows.count():
            raise ContractError("frequencies don't add up to their pairs")
    contained(kept, "tag", pairs.select(F.col("tag").alias("id")).distinct())
    final = unique(frequencies(kept), "tag")
    if final.count() != kept.select("tag").distinct().count():
        raise ContractError("final tags are counted twice")
    if config.blacklist:
        holds(kept, ~F.col("tag").isin(*config.blacklist), "blacklisted tag")
    rows = verdicts(pairs, config).join(kept.select("tag").distinct(), "tag", "left_semi")
    holds(rows, ~F.col("too_frequent"), "too frequent tag")
    holds(rows, ~F.col("rare"), "rare tag")
    holds(rows, F.col("protected") | (F.col("freq") >= config.min_freq), "unprotected tag below the least frequency")
    holds(rows, F.col("protected") | (F.col("freq") <= F.col("n_items") * F.lit(config.max_ratio)), "unprotected tag above the largest frequency")
    return kept


def before_after(items: DataFrame, before: TagConfig, after: TagConfig) -> DataFrame:
    """(metric, before, after) of two cleanings: final tags, mean tags an item, items with tags, pairs."""

    def measured(config: TagConfig, out: str) -> DataFrame:
        rows = clean(items, config).agg(F.count_distinct("tag").alias("n_tags"), F.count_distinct("app_id").alias("n_items"), F.count("*").alias("n_pairs"))
        values = {"n_tags": F.col("n_tags"), "avg_tags_per_item": F.coalesce(ratio(F.col("n_pairs"), F.col("n_items"), 4), F.lit(0.0)), "n_items": F.col("n_items"), "n_pairs": F.col("n_pairs")}
        cells = F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias(out)) for m, v in values.items()])
        return rows.select(F.explode(cells).alias("x")).select("x.*")

    return measured(before, "before").join(measured(after, "after"), "metric")


def survivors(items: DataFrame, config: TagConfig, watched: tuple[str, ...]) -> DataFrame:
    """(tag, freq) of the watched tags that are left after all filters."""
    return frequencies(clean(items, config)).where(F.col("tag").isin(*watched))


def renamed(pairs: DataFrame) -> DataFrame:
    """How often each tag was renamed to which."""
    return pairs.where("tag_original <> tag").groupBy("tag_original", "tag").agg(F.count("*").alias("freq"))


def tags_per_item(pairs: DataFrame) -> DataFrame:
    rows = pairs.groupBy("app_id").agg(F.countDistinct("tag").alias("n"))
    return rows.agg(F.count("*").alias("n_items"), F.min("n").alias("min_tags"), F.max("n").alias("max_tags"), F.round(F.avg("n"), 4).alias("avg_tags"), F.percentile("n", F.lit(0.5)).alias("median_tags"))


def overlap_stats(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sizes of two id sets, of their intersection and both differences; each side is counted by one flag per id."""
    flags = left.select("app_id").distinct().withColumn("l", F.lit(1)).withColumn("r", F.lit(0)).unionByName(right.select("app_id").distinct().withColumn("l", F.lit(0)).withColumn("r", F.lit(1)))
    ids = flags.groupBy("app_id").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    rows = ids.agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"), F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("n_common"))
    return rows.select("n_left", "n_right", "n_common", (F.col("n_left") - F.col("n_common")).alias("n_left_only"), (F.col("n_right") - F.col("n_common")).alias("n_right_only"), percent(F.col("n_common"), F.col("n_left")).alias("pct_left"), percent(F.col("n_common"), F.col("n_right")).alias("pct_right"))
