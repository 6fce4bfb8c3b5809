"""Mixing sources to target weights by Pareto order sampling; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import all_columns
from weftgraph.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Cells of one histogram level; two levels leave about a row in CELLS squared to sort exactly.
CELLS = 4096
#: Bits of a row's number within one chunk of repeated rows.
CHUNK_BITS = 16


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill(rows: DataFrame, by: list[str], weight: str, cap: str, total: str, order: list[Column], out: str) -> DataFrame:
    """Share `total` within each group `by` in proportion to `weight`, none above `cap`, excess reshared until none is above.

    In closed form: with rows in order of cap / weight, a row is at its cap if that
    quotient is at most (total - caps before) / (weights from here on); the first row
    above it gives the rate of all that follow. One row a source or class goes through the window.
    """
    part = Window.partitionBy(*by) if by else Window.partitionBy()
    w = part.orderBy(F.col("_ratio"), *order)
    rows = rows.withColumn("_ratio", F.try_divide(F.col(cap).cast("double"), F.col(weight).cast("double")))
    rows = rows.withColumn("_caps", F.coalesce(F.sum(cap).over(w.rowsBetween(Window.unboundedPreceding, -1)).cast("double"), F.lit(0.0)))
    rows = rows.withColumn("_rate", F.try_divide(F.col(total) - F.col("_caps"), F.sum(weight).over(w.rowsBetween(0, Window.unboundedFollowing)).cast("double")))
    rows = rows.withColumn("_n", F.row_number().over(w))
    rows = rows.withColumn("_final", F.min(F.when(F.col("_ratio") > F.col("_rate"), F.struct("_n", "_rate"))).over(part))
    free = F.col("_ratio") > F.col("_rate")
    return rows.withColumn(out, F.when(free, F.least(F.col("_final._rate") * F.col(weight), F.col(cap).cast("double"))).otherwise(F.col(cap).cast("double"))).drop("_ratio", "_caps", "_rate", "_n", "_final")


def size_class(size: Column) -> Column:
    """Number of binary digits of the size."""
    return F.when(size > 0, F.floor(F.log2(size.cast("double"))) + 1).otherwise(0).cast("int")


def sized_rows(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, size, class, `key` (a hash of doc_id, source and text) and `more` of each row."""
    doc_id, source, text = F.col("doc_id").cast("long"), F.col("source").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.xxhash64(doc_id.isNull(), doc_id, source.isNull(), source, text)
    rows = docs.select(doc_id.alias("doc_id"), source.alias("source"), words(F.col("text")).alias("size"), key.alias("key"), *more)
    return rows.withColumn("class", size_class(F.col("size")))


def numbered(rows: DataFrame) -> DataFrame:
    """`rows` with `occurrence`: rows of one `key` are numbered from 0.

    Only rows whose key repeats are moved. They are numbered in chunks of a bounded size, and the chunks of a key by what comes
    before them, so a key with a third of all rows is in no single task.
    """
    repeats = materialize(rows.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key"))
    first = F.lit(0).cast("long")
    if not repeats.take(1):
        return rows.withColumn("occurrence", first)
    again = materialize(rows.join(repeats, "key", "left_semi").withColumn("_chunk", F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS)))
    sizes = again.groupBy("key", "_chunk").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("key").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(F.col("key").alias("_k"), F.col("_chunk").alias("_c"), F.coalesce(before, first).alias("_before"))
    place = F.row_number().over(Window.partitionBy("key", "_chunk").orderBy("size"))
    again = again.withColumn("_place", place).join(offsets, (F.col("key") == F.col("_k")) & (F.col("_chunk") == F.col("_c")))
    again = again.withColumn("occurrence", F.col("_before") + F.col("_place") - 1).select(*rows.columns, "occurrence")
    return rows.join(repeats, "key", "left_anti").withColumn("occurrence", first).select(*rows.columns, "occurrence").unionByName(again)


def pareto_rank(share: Column, seed: int) -> Column:
    """Random odds over inclusion odds, mapped to (0, 1); the random number hangs on doc_id, source, text and, of repeated rows, the occurrence."""
    bits = F.pmod(F.xxhash64(F.lit(seed), F.col("key"), F.col("occurrence")), F.lit(1 << 52))
    u = (bits.cast("double") + 0.5) / float(1 << 52)
    return u * (1 - share) / (u * (1 - share) + share * (1 - u))


def plan(sized: DataFrame, total: float | None = None, weights: tuple[int, ...] = (1, 2, 3), most_copies: int = 3, preference: float = 1 / 16, seed: int = 20) -> DataFrame:
    """What each (source, size class) gets: whole copies, share of one more, and the cutoff of its source.

    Sources in code point order, null last, have `weights` in turn and share `total`
    (words; None: all of them), none above `most_copies` times its words. Within a source the expected copies
    of a document grow by `preference` of its size class, up to `most_copies`; the whole
    part is allocated to all, and the rest is sampled: documents are taken by rising
    Pareto rank until their words come nearest to what is left. The cutoff of that
    order comes from two levels of histograms and one exact sort within a cell, so that
    a source with a third of all rows is never sorted, or held, in one task. `sized` has the
    numbered rows of `sized_rows`; no two of them tie, as repeated rows differ in their occurrence.
    """
    classes = materialize(sized.groupBy("source", "class").agg(F.sum("size").alias("class_size"), F.count("*").alias("class_docs")))
    sources = classes.groupBy("source").agg(F.sum("class_size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*[F.lit(w) for w in weights])
    sources = sources.withColumn("_weight", F.element_at(cycle, (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn("_cap", F.col("source_size") * most_copies)
    whole = F.sum("source_size").over(Window.partitionBy()).cast("double") if total is None else F.lit(float(total))
    sources = fill(sources.withColumn("_total", whole), [], "_weight", "_cap", "_total", [F.col("source").asc_nulls_last()], "target").select("source", "source_size", "target")
    got = classes.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    got = got.withColumn("_weight", (1 + F.col("class") * preference) * F.col("class_size")).withColumn("_cap", F.col("class_size") * most_copies)
    got = fill(got, ["source"], "_weight", "_cap", "target", [F.col("class")], "_words")
    expected = F.coalesce(F.try_divide(F.col("_words"), F.col("class_size").cast("double")), F.lit(0.0))
    got = got.withColumn("_expected", F.least(expected, F.lit(float(most_copies))))
    got = got.withColumn("copies", F.floor(F.col("_expected") + 1e-9).cast("long")).withColumn("share", F.greatest(F.col("_expected") - F.col("copies"), F.lit(0.0)))
    got = got.withColumn("share", F.when(F.col("share") < 1e-9, 0.0).otherwise(F.col("share")))
    got = materialize(got.withColumn("_left", F.sum(F.col("share") * F.col("class_size")).over(Window.partitionBy("source"))).select("source", "class", "source_size", "target", "copies", "share", "_left"))
    ranked = with_plan(sized, got).where("share > 0").select("source", "size", "_left", pareto_rank(F.col("share"), seed).alias("rank"))
    cut = got.select("source", F.col("_left").alias("_rest"), F.lit(0).cast("long").alias("_cell")).distinct()
    scale = 1
    for _ in range(2):
        scale *= CELLS
        cut = _narrow(ranked, cut, scale)
    last = _in_cell(ranked, cut, scale)
    cum = F.sum("size").over(Window.partitionBy("source").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    last = last.withColumn("_cum", cum).where(F.col("_cum") - F.col("size") / 2 <= F.col("_rest")).groupBy("source").agg(F.max("rank").alias("_exact"))
    # Every cell before the last is taken whole; in it, up to the exact rank.
    cutoff = cut.alias("c").join(last.alias("l"), F.col("c.source").eqNullSafe(F.col("l.source")), "left")
    cutoff = cutoff.select(F.col("c.source").alias("_s"), F.coalesce(F.col("_exact"), F.col("_cell") / float(scale)).alias("cutoff"))
    return materialize(got.join(cutoff, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "class", "source_size", "target", "copies", "share", F.coalesce("cutoff", F.lit(0.0)).alias("cutoff")))


def _in_cell(ranked: DataFrame, cut: DataFrame, scale: int) -> DataFrame:
    cut = cut.select(F.col("source").alias("_s"), "_rest", "_cell")
    inside = F.col("source").eqNullSafe(F.col("_s")) & (F.floor(F.col("rank") * scale) == F.col("_cell"))
    return ranked.drop("_left").join(cut, inside).drop("_s")


def _narrow(ranked: DataFrame, cut: DataFrame, scale: int) -> DataFrame:
    """From the cell of each source where its words run out to the cell, CELLS times as fine, where they do."""
    inside = _in_cell(ranked, cut, scale // CELLS) if scale > CELLS else ranked.withColumn("_rest", F.col("_left")).withColumn("_cell", F.lit(0).cast("long"))
    cells = inside.withColumn("_cell", F.least(F.floor(F.col("rank") * scale), F.lit(scale - 1)).cast("long")).groupBy("source", "_cell", "_rest").agg(F.sum("size").alias("_words"))
    before = F.coalesce(F.sum("_words").over(Window.partitionBy("source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("_before", before).where(F.col("_before") <= F.col("_rest"))
    # The last cell that starts at or before the end.
    last = cells.groupBy("source").agg(F.max(F.struct("_cell", (F.col("_rest") - F.col("_before")).alias("_rest"))).alias("x"))
    return materialize(last.select("source", F.col("x._rest").alias("_rest"), F.col("x._cell").alias("_cell")))


def with_plan(sized: DataFrame, planned: DataFrame) -> DataFrame:
    """Rows with the plan of their source and class. The plan has a row for each of them; Catalyst broadcasts it while its files are small."""
    p = planned.withColumnsRenamed({"source": "_s", "class": "_c"})
    return sized.join(p, F.col("source").eqNullSafe(F.col("_s")) & (F.col("class") == F.col("_c"))).drop("_s", "_c")


def mix(docs: DataFrame, seed: int = 20, **options) -> DataFrame:
    """Per row of `docs`: doc_id, size, source_size, target, taken, and copies and share behind them.

    Whole copies first, then Pareto order sampling of one more; no document is taken
    more than `most_copies` times. The choice depends on doc_id, source and text alone, so
    reruns agree; of repeated rows as many get one more copy as the sample asks for, and as they are alike it does not
    matter which. Null text has size 0 and is never
    taken; a null source is a source of its own, last; a null doc_id is sampled
    like any other; texts of any length are counted whole, by map, and never moved; an empty table gives an empty result;
    other columns are not read.
    """
    sized = materialize(numbered(materialize(sized_rows(docs))))
    rows = with_plan(sized, plan(sized, seed=seed, **options))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * times(seed)).alias("taken"), "source", "copies", "share")


def times(seed: int) -> Column:
    """How often the planned row is taken."""
    extra = F.when((F.col("share") > 0) & (pareto_rank(F.col("share"), seed) <= F.col("cutoff")), 1).otherwise(0)
    return F.when(F.col("size") > 0, F.col("copies") + extra).otherwise(0).cast("long")


def mix_rows(docs: DataFrame, seed: int = 20, **options) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it, with the columns of `docs`; only texts of repeated rows are shuffled.

    Columns of any name are carried along. Edge cases as in `mix`; rows that are never taken go.
    """
    planned = plan(numbered(materialize(sized_rows(docs))), seed=seed, **options)
    rows = numbered(sized_rows(docs, F.struct(*all_columns(docs)).alias("_row")))
    rows = with_plan(rows, planned).withColumn("_times", times(seed)).where("_times > 0")
    copies = F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))
    return rows.select("_row", copies.alias("_copy")).select("_row.*")
