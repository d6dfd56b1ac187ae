"""Arrow UDFs that turn few rows at a time into Python objects."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Bytes of Arrow data that are Python objects, and 10 to 30 times as large, at a time.
MOST = 1 << 18


def slices(columns: tuple[pa.Array, ...], most: int = MOST) -> Iterator[tuple[pa.Array, ...]]:
    """The columns in pieces of at most `most` bytes together; a row that is larger is a piece of its own."""
    n = len(columns[0])
    if n > 1 and sum(c.nbytes for c in columns) > most:
        for part in (slice(0, n // 2), slice(n // 2, n)):
            yield from slices(tuple(c[part] for c in columns), most)
    else:
        yield columns


def by_row(f: Callable, kind: str):
    """A UDF of a function of a row's values that gives a value of the SQL type `kind`. A batch stays as Arrow has it, but for a
    slice, and so do the results. Made when it is called, for it needs a session."""
    made = to_arrow_type(DataType.fromDDL(kind))

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            for part in slices(columns if isinstance(columns, tuple) else (columns,)):
                yield pa.array([f(*row) for row in zip(*(c.to_pylist() for c in part))], made)

    return F.arrow_udf(run, kind)
