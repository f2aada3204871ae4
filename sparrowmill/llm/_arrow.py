"""Helpers shared by the Arrow-batched operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F, types as T


def strings(column: pa.Array) -> list[str]:
    """Python strings of a text column, nulls as empty texts."""
    return pc.fill_null(column, "").to_pylist()


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column, nulls as empty texts."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return pc.fill_null(column.cast(kind), b"").to_pylist()


def batches_of(texts: list, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` that hold about ``most`` bytes or characters each."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text) + 1
        if held >= most:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def text_slices(batch: pa.RecordBatch, most: int = 1 << 20, name: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch that hold about ``most`` bytes of text each, with the texts' UTF-8.

    Python copies of texts exist for a slice at a time only, and what Arrow has freed goes back after
    the batch: a worker lives on from stage to stage.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype("int64") + 1
    ends = (sizes.cumsum() // most).tolist()
    begin = 0
    for i in range(1, batch.num_rows + 1):
        if i == batch.num_rows or ends[i] != ends[begin]:
            part = batch.slice(begin, i - begin)
            yield part, utf8(part.column(name))
            begin = i
    pa.default_memory_pool().release_unused()


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches cut into a few rows each, for columns of lists that become Python objects."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def empty_row_id():
    """crc32 input of the id rule: the id as text, a null id as the empty text."""
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def id_remainder(modulus: int):
    """crc32(doc_id as text) mod ``modulus``; a null id counts as the empty text."""
    return F.crc32(empty_row_id().cast("binary")) % modulus


def fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])
