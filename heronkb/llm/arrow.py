"""Row-wise Arrow stages: one Python generator per partition, bounded by Spark's own batch size in bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: What a Python worker keeps from task to task, by name.
_kept: dict[str, Any] = {}


def kept(name: str, make: Callable[[], Any]) -> Any:
    """One object for each worker, made anew when it is not there; tasks that don't name it in ``keeps`` drop it."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def drop_all_but(name: str | None) -> None:
    for other in [x for x in _kept if x != name]:
        del _kept[other]


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 of a string column without decoding it."""
    return column.cast(pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose values in a string column have about ``size`` bytes, or one row with more."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def map_rows(df: DataFrame, schema: str, start: Callable[[], Callable[[pa.RecordBatch], dict[str, list[Any]]]], by: str | None = None, size: int = 1 << 20, keeps: str | None = None) -> DataFrame:
    """``start`` runs once in each task and gives a function from a batch to the columns of ``schema``.

    With ``by``, a string column, it gets batches of about ``size`` bytes of it. Of what the worker has ``kept`` only
    ``keeps`` stays, so that a stage doesn't run beside the memory of the one before.
    """
    kind = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_all_but(keeps)
        each = start()
        for batch in batches:
            for part in slices(batch, by, size) if by else [batch] if batch.num_rows else []:
                columns = each(part)
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def pass_rows(df: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], by: str | None = None, size: int = 1 << 20) -> DataFrame:
    """As ``map_rows``, for stages that keep the schema: they drop rows or replace columns of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_all_but(None)
        each = start()
        for batch in batches:
            for part in slices(batch, by, size) if by else [batch] if batch.num_rows else []:
                yield each(part)

    return df.mapInArrow(run, df.schema)
