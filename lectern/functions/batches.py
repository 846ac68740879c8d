"""Record batches in pieces: Spark bounds batches by rows, whatever these hold."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of a record batch that a function gets at once, unless a single row has more.
PIECE_BYTES = 4 << 20


def pieces(batch: pa.RecordBatch):
    """batch in runs of rows of about PIECE_BYTES."""
    rows = max(1, batch.num_rows * PIECE_BYTES // max(1, batch.nbytes))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def map_rows(df: DataFrame, fn: Callable, fields: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """df through fn (the values of a row to any number of tuples); fields: name, Arrow type and Spark type of each column."""
    schema = pa.schema([(name, kind) for name, kind, _ in fields])

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                rows = [out for row in zip(*(c.to_pylist() for c in piece.columns), strict=True) for out in fn(*row)]
                columns = zip(*rows, strict=True) if rows else ([] for _ in fields)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return df.mapInArrow(run, ", ".join(f"`{name}` {kind}" for name, _, kind in fields))
