"""Adds columns computed from a text column, chunk by chunk, in one narrow pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .store import modest
from .textscan import Chunk, chunks, settle


def with_text_columns(df: DataFrame, text: str, fields: str | StructType, make: Callable[[], Callable[[Chunk], dict]], drop: tuple[str, ...] = (), size: int | None = None) -> DataFrame:
    """df without ``drop``, and with ``fields`` that ``make()(chunk)`` gives as arrays.

    ``make`` is called once for each task.  A column of df that has the name of
    a new one is replaced.  Null texts are scanned as empty ones.
    """
    modest(df.sparkSession)
    new = StructType.fromDDL(fields) if isinstance(fields, str) else fields
    gone = {*new.names, *drop}
    kept = [f for f in df.schema.fields if f.name not in gone]
    kept_names = [f.name for f in kept]
    schema = StructType([*kept, *new.fields])
    arrow = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for c in chunks(column, size):
                got = of(c)
                part = batch.slice(c.first, len(c))
                arrays = [part.column(part.schema.get_field_index(n)) for n in kept_names]
                arrays += [got[f.name] if isinstance(got[f.name], pa.Array) else pa.array(got[f.name], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept_names, *arrow.names])
            settle()

    return df.mapInArrow(run, schema)
