"""Chat formatting: logged snapshots of a conversation collapse to the longest, which is rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.session import materialize

#: Turns of one block: hashes are accumulated within blocks, then over the blocks of a conversation.
BLOCK = 256
LAST = (1 << 62) - 1
START, END = "<|im_start|>", "<|im_end|>"


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Every turn with the rolling 128-bit hash (`h0`, `h1`) of its conversation up to it.

    A turn hashes its number, role and text; a prefix is the exclusive or of its turns, so it
    accumulates over blocks of turns and then over blocks, and a conversation with a third
    of all rows is not one task's.
    """
    cells = [F.xxhash64(F.lit(seed), "turn", F.coalesce("role", F.lit("\x00")), F.coalesce("text", F.lit("\x00"))) for seed in (3, 30)]
    rows = turns.withColumn("block", F.floor(F.col("turn") / BLOCK)).withColumns({f"c{i}": c for i, c in enumerate(cells)})
    # bit_xor counts a repeated row twice, so turns have to be distinct.
    blocks = rows.groupBy("conv_id", "block").agg(*[F.bit_xor(f"c{i}").alias(f"b{i}") for i in (0, 1)])
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", *[F.coalesce(F.bit_xor(f"b{i}").over(before), F.lit(0)).alias(f"b{i}") for i in (0, 1)])
    within = Window.partitionBy("conv_id", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"w{i}": F.bit_xor(f"c{i}").over(within) for i in (0, 1)})
    return rows.join(blocks, ["conv_id", "block"]).select("conv_id", "turn", *[F.col(f"b{i}").bitwiseXOR(F.col(f"w{i}")).alias(f"h{i}") for i in (0, 1)])


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id of the conversations that are no proper prefix of another; of equal ones, the smallest."""
    hashes = materialize(prefix_hashes(turns).distinct())
    ends = hashes.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    whole = hashes.join(ends, ["conv_id", "turn"], "left_semi").groupBy("h0", "h1").agg(F.min("conv_id").alias("conv_id"))
    inner = hashes.join(ends.withColumnRenamed("turn", "last"), "conv_id").where("turn < last").select("h0", "h1").distinct()
    return whole.join(inner, ["h0", "h1"], "left_anti").select("conv_id")


def rendered(role: Column, text: Column) -> Column:
    """One turn as the chat template writes it; the template's own marks inside a text are broken by a space."""
    clean = F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))
    return F.concat(F.lit(START), F.coalesce(role, F.lit("user")), F.lit("\n"), clean, F.lit(END + "\n"))


def collapse(conversations: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns and its rendered text.

    Null texts are empty and null roles `user` when rendered, but a null differs from an empty one when
    conversations are compared; a null turn comes last. Rows without a conv_id belong to no conversation and are left out;
    repeated rows count once; several rows of one turn are written by role and text.
    An empty table gives an empty result; other columns are not read. A conversation is one row of
    the result, so its text has to fit in memory; turns are hashed whole, whatever their length. Prefixes are equal if 128 bits of
    hash over all their turns are: texts are not compared again.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(LAST)).alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    # Texts are written once, and read by both the hashes and the rendering.
    turns = materialize(turns.where("conv_id IS NOT NULL").distinct())
    kept = turns.join(maximal(turns), "conv_id", "left_semi")
    lines = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("r"), rendered(F.col("role"), F.col("text")).alias("line"))))
    return kept.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("text"))


#: The same as `collapse`, for DuckDB: prefixes are compared as strings.
SQL = """
WITH turns AS (
  SELECT DISTINCT conv_id, coalesce(turn, 4611686018427387903) AS turn, role, text FROM conversations WHERE conv_id IS NOT NULL
), prefixes AS (
  SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS last,
    string_agg(turn || chr(31) || coalesce(role, chr(1)) || chr(31) || coalesce(text, chr(1)), chr(30)) OVER (PARTITION BY conv_id ORDER BY turn) AS pre
  FROM turns
), kept AS (
  SELECT min(conv_id) AS conv_id FROM prefixes WHERE turn = last AND pre NOT IN (SELECT pre FROM prefixes WHERE turn < last) GROUP BY pre
)
SELECT conv_id, count(*) AS n_turns,
  string_agg('<|im_start|>' || coalesce(role, 'user') || chr(10) || replace(coalesce(text, ''), '<|im_', '<| im_') || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS text
FROM turns WHERE conv_id IN (SELECT conv_id FROM kept) GROUP BY conv_id
"""
