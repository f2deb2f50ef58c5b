"""Record batches with the types a schema names, whatever the rows hold."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

TYPES = {
    "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
    "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
}


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows of ``schema``, a list of ``name type`` parts, as one batch."""
    parts = [p.split() for p in schema.split(", ")]
    columns = zip(*rows) if rows else [()] * len(parts)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), TYPES[t]) for c, (_, t) in zip(columns, parts)], [n for n, _ in parts]
    )


def small(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that what Python builds
    from one of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
