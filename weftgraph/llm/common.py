"""What the corpus operators share: narrow reads and Arrow maps over whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that an Arrow map holds at once; one longer text makes a batch of its own.
BATCH_BYTES = 4 << 20


_memories: dict[str, Callable[[], None]] = {}


def claim(owner: str, forget: Callable[[], None]) -> None:
    """Make room in a reused Python worker: what other operators remember is forgotten, `forget` being how to do so for `owner`."""
    for other in [o for o in _memories if o != owner]:
        _memories.pop(other)()
    _memories[owner] = forget


def all_columns(docs: DataFrame) -> list[Column]:
    """Every column of `docs`, whatever its name."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def text_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """`id_col`, the UTF-8 bytes of `text_col` as `body` (null: empty) and `extra`; every other column is dropped."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"), *[F.col(c) for c in extra])


def map_texts(rows: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, most: int = BATCH_BYTES) -> DataFrame:
    """`rows.mapInArrow` with batches cut so that `body` holds about `most` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut_batch(batch, most):
                yield fn(part)

    return rows.mapInArrow(run, schema)


def cut_batch(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    lengths = pc.binary_length(batch.column("body")).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start)
