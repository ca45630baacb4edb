"""What the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkforge.scratch import Scratch, shared_dir

__all__ = ["Scratch", "arrow_map", "ascii_lower", "shared_dir"]

#: White space of the word contracts, as a Java or RE2 character class body.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(c, UPPER, LOWER)


def arrow_map(df: DataFrame, rows: Callable[[dict[str, list]], dict[str, list]], schema: str, size: int = 256) -> DataFrame:
    """mapInArrow over blocks of at most size rows: rows gets and returns columns as lists (or arrays)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                out = rows(batch.slice(at, size).to_pydict())
                yield pa.RecordBatch.from_pydict({f.name: pa.array(out[f.name], f.type) for f in want})

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    want = list(to_arrow_schema(_parse_datatype_string(schema)))
    return df.mapInArrow(run, schema)
