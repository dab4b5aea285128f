"""Columns computed from one text column in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows go through Python in slices of about this many bytes of text.
SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, column: pa.Array) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about :data:`SLICE_BYTES` of ``column`` each."""
    start = size = 0
    for i, n in enumerate(pa.compute.binary_length(column).fill_null(0).to_pylist()):
        if size and size + n > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if len(batch) > start:
        yield batch.slice(start)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named ``_in_0``, ``_in_1``, ..., so that no name of a caller's meets one of ours."""
    return df.toDF(*(f"_in_{i}" for i in range(len(df.columns))))


def named(df: DataFrame, columns: Sequence[str], *more: str) -> DataFrame:
    """The columns of a :func:`numbered` frame by their old names, and ``more``."""
    return df.select(*(F.col(f"_in_{i}").alias(c) for i, c in enumerate(columns)), *more)


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until ``df`` has no such column."""
    while name in df.columns:
        name += "_"
    return name


def add_columns(
    df: DataFrame,
    column: str,
    added: T.StructType,
    compute: Callable[[list], Sequence[Sequence]],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``df`` (or its columns ``keep``) with the columns ``added`` computed from ``column``.

    ``compute`` takes a list of texts and gives one sequence for each added column.  A
    column of ``df`` that has the name of an added one gives way to it.
    """
    names = {f.name for f in added}
    kept = [f for f in df.schema if f.name not in names and (keep is None or f.name in keep)]
    schema = T.StructType([*kept, *added])
    types = [to_arrow_type(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column))
            for part in slices(batch, texts):
                values = compute(part.column(part.schema.get_field_index(column)).to_pylist())
                arrays = [part.column(part.schema.get_field_index(f.name)) for f in kept]
                arrays += [v if isinstance(v, pa.Array) else pa.array(v, type=t) for v, t in zip(values, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    needed = [f.name for f in kept] + [column] * (column not in {f.name for f in kept})
    return df.select(*(f"`{n}`" for n in needed)).mapInArrow(run, schema)
