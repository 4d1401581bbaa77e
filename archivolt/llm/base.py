"""Shared parts: input columns and byte-bounded slices of Arrow batches.

Every operator first narrows its input to the columns it needs with
``columns``; so extra columns, whatever their names, never reach it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Shared
from ..sources.tables import table

__all__ = ["Shared", "carried", "columns", "slices", "table", "texts"]

#: Text bytes that a worker turns into Python objects at a time.
SLICE_BYTES = 4 << 20


def columns(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns alone; ``doc_id`` as long and ``text`` as string."""
    kinds = {"doc_id": "bigint", "text": "string"}
    return docs.select(*(F.col(f"`{n}`").cast(kinds[n]).alias(n) if n in kinds else F.col(f"`{n}`") for n in names))


def carried(docs: DataFrame, extra: tuple[str, ...]) -> tuple[DataFrame, list[str], str]:
    """``doc_id`` and ``text`` with the columns to carry along; under which name each comes; their part of a schema.

    Carried columns are x0, x1 and so on in a result; a ``doc_id`` or ``text`` among them
    that is what the operator reads comes but once.
    """
    once = {"doc_id": "bigint", "text": "string"}
    kinds = [docs.schema[c].dataType.simpleString() for c in extra]
    names = [c if once.get(c) == kind else f"x{i}" for i, (c, kind) in enumerate(zip(extra, kinds, strict=True))]
    own = [c for c, n in zip(extra, names, strict=True) if n != c]
    src = columns(docs, "doc_id", "text").select("doc_id", "text") if not own else docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(f"`{c}`").alias(n) for c, n in zip(extra, names, strict=True) if n != c)
    )
    return src, names, "".join(f", x{i} {kind}" for i, kind in enumerate(kinds))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``most`` text bytes; one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i in range(n):
            if held and held + size[i] > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size[i])
        yield batch.slice(start, n - start)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column as Python strings; null is the empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]
