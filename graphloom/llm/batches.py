"""Arrow batches of text columns, handed to a function in bounded pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

#: Bytes of the column that are held as Python objects at a time; a longer value makes a piece of its own.
PIECE_BYTES = 4_000_000
#: Rows and bytes of the batches that go to a Python worker.
BATCH_ROWS, BATCH_BYTES = 2_000, 8_000_000


def pieces(batch: pa.RecordBatch, column: str | int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about PIECE_BYTES of the column."""
    n = batch.num_rows
    if n == 0:
        return
    at = column if isinstance(column, int) else batch.schema.get_field_index(column)
    per_row = max(1, batch.column(at).nbytes // n)
    step = max(1, PIECE_BYTES // per_row)
    for start in range(0, n, step):
        yield batch.slice(start, step)


def in_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``df.mapInArrow``, with small batches: the session's limits are lowered, as a batch of long texts takes its size twice in each task."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(work, schema)


def without(names: Iterable[str], taken: Iterable[str]) -> list[str]:
    """The names that Spark, which ignores case, tells from all those taken."""
    own = {c.lower() for c in taken}
    return [c for c in names if c.lower() not in own]


def placed(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``df`` with columns named by their place, c0, c1, ..., so that no name clashes with another, and what ``names`` are called then."""
    lower = [c.lower() for c in df.columns]
    return df.toDF(*[f"c{i}" for i in range(len(lower))]), [f"c{lower.index(n.lower())}" for n in names]


def map_text(df: DataFrame, column: str, new: list[StructField], run: Callable[[list], list[list]], keep: bool = True) -> DataFrame:
    """``df`` with the columns that ``run`` gives for the values of ``column``.

    ``run`` maps a list of values to one list for each new field.  Columns of the
    same names, whatever their case, are replaced; the others pass through as
    Arrow arrays, ``column`` only with ``keep``.
    """
    fields = df.schema.fields
    names = [f.name.lower() for f in fields]
    source = names.index(column.lower())
    taken = {f.name.lower() for f in new}
    kept = [i for i, name in enumerate(names) if name not in taken and (keep or i != source)]
    schema = StructType([*[fields[i] for i in kept], *new])
    types = [to_arrow_type(f.dataType) for f in new]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, source):
                values = batch.column(source).to_pylist()
                made = [pa.array(v, t) for v, t in zip(run(values), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *made], names=schema.names)

    return in_arrow(df, work, schema)
