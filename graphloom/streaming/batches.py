"""Batches of a stream of messages, cut by their number or by the span of their times.

The messages of a partition, the ``key`` here, follow one another by time.  A message
joins the open batch of its key, and closes it if the batch then has ``size`` messages
or its time is more than ``span`` behind the first one's.  What is open is kept as the
key's state, so the cuts depend on the messages and not on the micro-batches that bring
them, as long as these come in the order of their times; a message that comes late joins
the batch that is open when it comes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType


def cuts(times: list[int], size: int, span: int, state: tuple[int, int, int] = (0, 0, 0)) -> tuple[list[int], tuple[int, int, int]]:
    """The number of each message's batch, and the state behind the last: the open batch, its messages and its first time."""
    batch, n, first = state
    out = []
    for t in times:
        if n == 0:
            first = t
        out.append(batch)
        n += 1
        if n >= size or t - first > span:
            batch, n = batch + 1, 0
    return out, (batch, n, first)


def numbered(messages: DataFrame, key: str, time: str, order: str, size: int, span: int) -> DataFrame:
    """(key, order, batch) of a stream of messages; ``time`` is a timestamp, ``span`` in microseconds.

    Messages of one time follow by ``order``.  Rows without a key are a partition of
    their own, and those without a time are left out.
    """
    if size < 1 or span < 0:
        raise ValueError("a batch has one message at least, and no negative span")
    schema = StructType([messages.schema[key], messages.schema[order], StructField("batch", LongType())])

    def run(own: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat([c[["__t", order]] for c in chunks]).sort_values(["__t", order])
        found, after = cuts(rows["__t"].tolist(), size, span, state.get if state.exists else (0, 0, 0))
        state.update(after)
        yield pd.DataFrame({key: [own[0]] * len(rows), order: rows[order], "batch": found})

    timed = messages.where(F.col(time).isNotNull()).select(key, order, F.unix_micros(F.col(time).cast("timestamp")).alias("__t"))
    return timed.groupBy(key).applyInPandasWithState(run, schema, "batch long, n long, first long", "append", GroupStateTimeout.NoTimeout)
