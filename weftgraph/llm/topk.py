"""Exact top-k search in Hamming space by incremental multi-index hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.session import materialize

#: Codes of an index cell: a few thousand are cheap to pack; up to MOST_CELL, cells grow with the table, so that a query visits few of them.
CELL, MOST_CELL = 1 << 14, 1 << 20
#: Search radii of the first round; each later round adds one.
FIRST_RADII = 2
#: Lookups, candidates and asked rows that a worker holds at once.
AT_ONCE = 1 << 20
#: Partitions of a round at most; cells share them beyond that.
MOST_PARTITIONS = 20_000

NEAR = "array<struct<d:int,id:long>>"


def binary_codes(vectors: pa.Array, width: int) -> np.ndarray:
    """A row of bytes for each vector, a bit for each component above 0, up to a multiple of 64 bits."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    above = np.nan_to_num(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)) > 0
    bits = np.zeros((len(lengths), -(-width // 64) * 64), dtype=np.uint8)
    row = np.repeat(np.arange(len(lengths)), lengths)
    bits[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = above
    return np.packbits(bits, axis=1)


@cache
def masks(bits: int, radius: int) -> np.ndarray:
    """The numbers of `bits` bits of which `radius` are set."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(bits), radius)], dtype=np.int64)


def packed_codes(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, -(-width // 64) * 8)


class Layout:
    """Segments of a code, and the cells of the index: codes whose segment starts with the same `prefix` bits.

    A segment has about log2(n) bits, so that a value of it is met by about one code.
    """

    def __init__(self, n: int, width: int):
        count = max(1, min(width, round(width / max(1.0, math.log2(max(n, 2))))))
        self.width = width
        self.bounds = [width * i // count for i in range(count + 1)]
        self.sizes = [b - a for a, b in zip(self.bounds, self.bounds[1:], strict=False)]
        cell = min(MOST_CELL, max(CELL, n // 256))
        self.prefix = min([*self.sizes, max(0, math.ceil(math.log2(max(n, 1) / cell)))])
        self.cell = cell

    def values(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each segment its value in each code."""
        bits = np.unpackbits(codes, axis=1).astype(np.int64)
        return [bits[:, a:b] @ (1 << np.arange(b - a - 1, -1, -1, dtype=np.int64)) for a, b in zip(self.bounds, self.bounds[1:], strict=False)]

    def covered(self, radius: int) -> int:
        """All codes up to this distance have been met once every segment was searched up to `radius`."""
        return self.width if radius >= max(self.sizes) else len(self.sizes) * (radius + 1) - 1


class Cell:
    """Codes of one cell in order of the rest of their segment, with the start of each value."""

    def __init__(self, payload: bytes, bits: int, words: int):
        n = len(payload) // (8 * (2 + words))
        values = np.frombuffer(payload, dtype=np.int64, count=n)
        self.ids = np.frombuffer(payload, dtype=np.int64, count=n, offset=8 * n)
        self.codes = np.frombuffer(payload, dtype=np.uint64, offset=16 * n).reshape(n, words)
        self.values, firsts = np.unique(values, return_index=True)
        self.starts = np.append(firsts, n)
        # Cells are about as large as their values are many, so a table of them costs no more than the codes.
        self.place = None
        if (1 << bits) <= 8 * n + 1024:
            self.place = np.full(1 << bits, -1, dtype=np.int64)
            self.place[self.values] = np.arange(len(self.values))

    def lookup(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each value the first of its codes, and how many there are."""
        if self.place is not None:
            at = self.place[wanted]
            hit = at >= 0
        else:
            at = np.minimum(np.searchsorted(self.values, wanted), len(self.values) - 1)
            hit = self.values[at] == wanted
        at = np.where(hit, at, 0)
        return self.starts[at], np.where(hit, self.starts[at + 1] - self.starts[at], 0)


def pack(values: np.ndarray, ids: np.ndarray, codes: np.ndarray) -> bytes:
    order = np.lexsort((ids, values))
    return values[order].tobytes() + ids[order].tobytes() + codes[order].tobytes()


def visit(cell: Cell, bits: int, radii: tuple[int, int], value: np.ndarray, spent: np.ndarray, codes: np.ndarray, bound: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, distance, id) of the `keep` nearest codes of the cell for each query, by distance, then id.

    Looked up are the values that differ from the query's in as many bits as the segment radius leaves once `spent` of
    them went into the cell's prefix. Candidates beyond `bound`, the distance of the last neighbour known, go at once.
    """
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for used in np.unique(spent).tolist():
        lo, hi = max(0, radii[0] - used), min(bits, radii[1] - used)
        wanted = [masks(bits, r) for r in range(lo, hi + 1)]
        if not wanted:
            continue
        probe = np.concatenate(wanted)
        mine = np.flatnonzero(spent == used)
        for at in range(0, len(mine), max(1, AT_ONCE // len(probe))):
            some = mine[at : at + max(1, AT_ONCE // len(probe))]
            first, n = cell.lookup((value[some][:, None] ^ probe[None, :]).ravel())
            hit = np.flatnonzero(n)
            first, n, q = first[hit], n[hit], some[hit // len(probe)]
            ends = np.cumsum(n)
            begin = 0
            while begin < len(n):
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + AT_ONCE, side="right")))
                c, f = n[begin:end], first[begin:end]
                rows = np.repeat(f - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
                who = np.repeat(q[begin:end], c)
                d = np.bitwise_count(cell.codes[rows] ^ codes[who]).sum(axis=1).astype(np.int64)
                near = np.flatnonzero(d <= bound[who])
                parts.append(_nearest(who[near], d[near], cell.ids[rows[near]], keep))
                begin = end
    if not parts:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    return _nearest(*(np.concatenate([p[i] for p in parts]) for i in range(3)), keep)


def _nearest(q: np.ndarray, d: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, d, q))
    q, d, ids = q[order], d[order], ids[order]
    if len(q):
        new = np.concatenate(([True], q[1:] != q[:-1]))
        place = np.arange(len(q)) - np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
        q, d, ids = q[place < keep], d[place < keep], ids[place < keep]
    return q, d, ids


def coded(vectors: DataFrame, width: int) -> DataFrame:
    """(vec_id, code) of each id; of rows that share one, the smallest code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = binary_codes(batch.column("embedding"), width)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "code"])

    return vectors.mapInArrow(run, "vec_id long, code binary").groupBy("vec_id").agg(F.min("code").alias("code"))


def _entries(layout: Layout):
    """Rows of (vec_id, code) as one entry for each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = packed_codes(batch.column("code"), layout.width)
            for s, values in enumerate(layout.values(codes) if len(codes) else []):
                low = layout.sizes[s] - layout.prefix
                cell = (np.int64(s) << 40) | (values >> low)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(values & ((1 << low) - 1)), batch.column("vec_id"), batch.column("code")], ["cell", "value", "vec_id", "code"])

    return run


def _packed(layout: Layout):
    """The entries of one piece of a cell as one row."""

    def run(table: pa.Table) -> pa.Table:
        codes = packed_codes(table.column("code"), layout.width)
        raw = pack(table.column("value").to_numpy(), table.column("vec_id").to_numpy(), codes)
        return pa.table([table.column("cell")[:1], table.column("salt")[:1], pa.array([raw], pa.binary())], ["cell", "salt", "payload"])

    return run


class Index:
    """The multi-index of a table of (vec_id, code): one row of packed codes for each cell of each segment, built once.

    Of rows with one code only the `keep` smallest ids can be in a result, as they come first among equals; so a code
    that a third of all rows share does not crowd its cells. A cell in which different codes crowd is dealt to `pieces`.
    """

    def __init__(self, rows: DataFrame, layout: Layout, keep: int):
        self.layout, self.keep = layout, keep
        place = F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))
        rows = rows.withColumn("_n", place).where(F.col("_n") <= keep).select("vec_id", "code")
        entries = rows.mapInArrow(_entries(layout), "cell long, value long, vec_id long, code binary")
        counts = entries.groupBy("cell").agg(F.count("*").alias("n"))
        hot = counts.where(F.col("n") > 4 * layout.cell).select("cell", F.ceil(F.col("n") / layout.cell).cast("long").alias("pieces"))
        self.hot = materialize(hot)
        self.has_hot = bool(self.hot.take(1))
        self.partitions = min(MOST_PARTITIONS, len(layout.sizes) << layout.prefix)
        entries = self._with_pieces(entries).withColumn("salt", F.pmod(F.xxhash64("code"), F.col("pieces"))).drop("pieces")
        self.table = materialize(entries.repartition(self.partitions, "cell", "salt").groupBy("cell", "salt").applyInArrow(_packed(layout), "cell long, salt long, payload binary"))

    def _with_pieces(self, rows: DataFrame) -> DataFrame:
        if not self.has_hot:
            return rows.withColumn("pieces", F.lit(1).cast("long"))
        return rows.join(self.hot, "cell", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1).cast("long")))

    def round(self, open_: DataFrame, n_open: int, radii: tuple[int, int]) -> DataFrame:
        """(code, near): what segment radii from radii[0] to radii[1] find for the open queries (code, bound)."""
        layout, keep = self.layout, self.keep
        lo, hi = radii
        prefix = np.concatenate([masks(layout.prefix, r) for r in range(0, min(hi, layout.prefix) + 1)])
        used = np.bitwise_count(prefix.astype(np.uint64)).astype(np.int64)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, AT_ONCE // (8 * len(prefix)))
            for whole in batches:
                for at in range(0, whole.num_rows, step):
                    batch = whole.slice(at, step)
                    for s, values in enumerate(layout.values(packed_codes(batch.column("code"), layout.width))):
                        low = layout.sizes[s] - layout.prefix
                        useful = used + low >= lo
                        rows = np.repeat(np.arange(batch.num_rows), int(useful.sum()))
                        cell = (np.int64(s) << 40) | ((values >> low)[:, None] ^ prefix[None, useful]).ravel()
                        columns = [pa.array(cell), pa.array((values & ((1 << low) - 1))[rows]), pa.array(np.tile(used[useful], batch.num_rows)), batch.column("code").take(pa.array(rows)), batch.column("bound").take(pa.array(rows))]
                        yield pa.RecordBatch.from_arrays(columns, ["cell", "value", "spent", "code", "bound"])

        def look(asked: pa.Table, cells: pa.Table) -> pa.Table:
            if not asked.num_rows or not cells.num_rows:
                return pa.table([pa.array([], pa.binary()), pa.array([], pa.list_(pa.struct([("d", pa.int32()), ("id", pa.int64())])))], ["code", "near"])
            bits = layout.sizes[asked.column("cell")[0].as_py() >> 40] - layout.prefix
            raw = packed_codes(asked.column("code"), layout.width)
            codes = np.ascontiguousarray(raw).view(np.uint64)
            cell = Cell(cells.column("payload")[0].as_py(), bits, codes.shape[1])
            value, spent, bound = (asked.column(c).to_numpy() for c in ("value", "spent", "bound"))
            q, d, ids = visit(cell, bits, radii, value, spent, codes, bound, keep)
            starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, dtype=np.int64)
            near = pa.ListArray.from_arrays(pa.array(np.append(starts, len(q)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(d.astype(np.int32)), pa.array(ids)], ["d", "id"]))
            return pa.table([pa.array([raw[i].tobytes() for i in q[starts]], pa.binary()), near], ["code", "near"])

        # A cell's queries are dealt to blocks once they are more than a worker should hold.
        blocks = F.col("pieces") * (1 + n_open * len(prefix) // ((1 << layout.prefix) * AT_ONCE))
        asked = self._with_pieces(open_.mapInArrow(ask, "cell long, value long, spent long, code binary, bound long"))
        asked = asked.withColumn("block", F.pmod(F.xxhash64(F.lit(10), "code"), blocks)).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).drop("pieces")
        cells = self._with_pieces(self.table).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).drop("pieces")
        key = ("cell", "salt", "block")
        asked, cells = (x.repartition(self.partitions, *key).groupBy(*key) for x in (asked, cells))
        return asked.cogroup(cells).applyInArrow(look, f"code binary, near {NEAR}")


def nearest(rows: DataFrame, queries: DataFrame, layout: Layout, keep: int) -> DataFrame:
    """(code, near, covered) of each distinct code of `queries`: its `keep` nearest of `rows`, and the distance proved when it was settled.

    Segment radii grow until the distance of the last neighbour is within what the radius covers: codes that differ in at
    most m (r + 1) - 1 bits differ in at most r bits in one of m segments. Settled queries leave.
    """
    index = Index(rows, layout, keep)
    state = materialize(queries.select("code").distinct().select("code", F.array().cast(NEAR).alias("near"), F.lit(-1).cast("long").alias("covered")))
    last = F.get("near", F.lit(keep - 1))["d"].cast("long")
    settled = F.coalesce(last <= F.col("covered"), F.lit(False)) | (F.col("covered") >= layout.width)
    radii = (0, min(FIRST_RADII, max(layout.sizes)))
    while n_open := state.where(~settled).count():
        open_ = state.where(~settled).select("code", F.coalesce(last, F.lit(layout.width)).cast("long").alias("bound"))
        # A code meets a query in several segments; what meets is the same row of (d, id).
        more = index.round(open_, n_open, radii).groupBy("code").agg(F.flatten(F.collect_list("near")).alias("more")).withColumnRenamed("code", "_code")
        rows = state.join(more, F.col("code") == F.col("_code"), "left")
        near = F.slice(F.array_sort(F.array_distinct(F.concat("near", F.coalesce("more", F.array().cast(NEAR))))), 1, keep)
        state = materialize(rows.select("code", near.alias("near"), F.when(settled, F.col("covered")).otherwise(layout.covered(radii[1])).alias("covered")))
        radii = (radii[1] + 1, radii[1] + 1)
    return state


def search(vectors: DataFrame, k: int = 10, query_every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, distance): for each row whose id is divisible by `query_every`, its k nearest other rows.

    Distance is the number of components whose signs differ; of equal distances the smaller id comes first. The result is
    exact, and every query is settled by the bound of its search radius (`nearest`). Queries with one code are searched
    once. A cell of the index and a block of queries are of a bounded size, so memory does not grow with the input.

    A vector without an id or components is neither query nor result; shorter vectors count as filled up with zeros; a
    null component counts as not above 0; rows that repeat an id count once, with the smallest code. An empty table
    gives an empty result; other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND size(embedding) > 0")
    n, width = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    layout = Layout(n, width or 1)
    codes = materialize(coded(rows, layout.width))
    queries = codes.where(F.col("vec_id") % query_every == 0)
    found = nearest(codes, queries, layout, k + 1)
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = queries.select(F.col("vec_id").alias("query_id"), "code").join(found, "code").select("query_id", F.posexplode(others).alias("_at", "_x"))
    return out.select("query_id", (F.col("_at") + 1).cast("long").alias("rank"), F.col("_x.id").alias("vec_id"), F.col("_x.d").cast("long").alias("distance"))


#: The same as `search`, for DuckDB.
SQL = """
WITH signs AS (
  SELECT vec_id, min(array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 AND NOT isnan(x) THEN '1' ELSE '0' END), '')) AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 GROUP BY 1
), codes AS (
  SELECT vec_id, rpad(code, CAST((SELECT max(length(code)) FROM signs) AS INTEGER), '0')::BIT AS code FROM signs
), far AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(bit_count(xor(q.code, r.code)) AS BIGINT) AS distance
  FROM codes q JOIN codes r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id
)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank, vec_id, distance FROM far) WHERE rank <= 10
"""
