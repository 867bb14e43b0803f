"""Rows to and from Python in Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A batch is given out at so many rows or bytes of texts and images; rows of a batch that came in are unpacked so many at a time.
ROWS, BYTES, UNPACKED = 1024, 4 << 20, 16


def arrow_schema(schema: str) -> pa.Schema:
    """Of a schema spelt out; made on the driver, for the tasks."""
    return to_arrow_schema(StructType.fromDDL(schema))


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of all batches, a few unpacked at a time: images are large."""
    for batch in batches:
        for at in range(0, batch.num_rows, UNPACKED):
            yield from batch.slice(at, UNPACKED).to_pylist()


def in_batches(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches; a batch for each row would cost more than most rows do."""
    held: list[dict] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row.values() if isinstance(v, (str, bytes)))
        if len(held) >= ROWS or size >= BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)
