"""Python operators over text columns, in slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE_ROWS = 256

Columns = dict[str, list]


def add_columns(df: DataFrame, inputs: Sequence[str], new: T.StructType, make: Callable[[], Callable[..., Columns]],
                carry: Sequence[str] | None = None) -> DataFrame:
    """``df`` with new columns computed in Python from the columns ``inputs``.

    ``make`` is called once per task and returns the function of the lists of inputs.  Batches are worked on in slices of
    ``SLICE_ROWS`` rows, so that results of long texts do not pile up.  ``carry`` names the columns that stay (default: all),
    which pass as they are; a column that has the name of a new one is replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    added = set(new.fieldNames())
    kept = [c for c in (df.columns if carry is None else carry) if c not in added]
    needed = [*kept, *(c for c in inputs if c not in kept)]
    schema = T.StructType([df.schema[c] for c in kept] + list(new.fields))
    kinds = {f.name: to_arrow_type(f.dataType) for f in new.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                got = work(*(part.column(c).to_pylist() for c in inputs))
                columns = {c: part.column(c) for c in kept} | {c: pa.array(got[c], type=kind) for c, kind in kinds.items()}
                yield pa.RecordBatch.from_pydict(columns)

    return df.select(*(f"`{c}`" for c in needed)).mapInArrow(run, schema)
