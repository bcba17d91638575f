"""Product codes of vectors by Lloyd's rounds with Hamerly's bounds, in exact integers.

A vector is cut into eight parts, and each part position has a codebook of its own.
The state of a vector is one row of a written table: its integers, and for each part
the entry, an upper bound of the distance to it and a lower bound of the distance to
the second nearest.  Bounds are whole numbers, rounded away from the true distance, so
they decide only what holds exactly.  After a round the upper bound grows by what its
entry has moved and the lower one shrinks by the furthest that another has; a part is
scanned only if its bounds, or half the way to the nearest other entry, don't tell
strictly that its entry is the only nearest one.  A scan takes the first of equals.

A round is one pass that reads a state and writes the next: each task also writes the
sums of its parts by entry, as a row of its own in a column that costs nothing to read
alone.  The driver sees those sums once Spark has added them up, as many numbers as
the codebooks have.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..plans.lineage import cut_table, remove, scratch_path
from .batches import in_arrow, pieces

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components are held to this size, so that their integers fit.
LARGEST = 2.0**40
#: Integers up to this size, in parts of up to 2^12 components, are squared and summed in 64 bits; others as Python's integers.
NARROW = 1 << 24
#: Of a long.
MOST = (1 << 63) - 1
#: Labels whose sums are broadcast; more are joined by a shuffle.
LABELS_SENT = 1_000_000
FAR = 1 << 60

root_of = np.frompyfunc(math.isqrt, 1, 1)


def roots(squares: np.ndarray) -> np.ndarray:
    """The largest whole number that is at most each square root."""
    if squares.dtype == object:
        return np.minimum(root_of(squares), FAR).astype(np.int64)
    r = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    r -= r * r > squares
    return r + ((r + 1) * (r + 1) <= squares)


def roots_up(squares: np.ndarray) -> np.ndarray:
    """The smallest whole number that is at least each square root."""
    r = roots(squares)
    return r + (r.astype(squares.dtype) ** 2 < squares)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances over the last axis; exact, whatever the integers."""
    if max(_size(a), _size(b)) > NARROW:
        a, b = a.astype(object), b.astype(object)
    d = a - b
    return (d * d).sum(axis=-1)


def _size(x: np.ndarray) -> int:
    return int(max(x.max(), -x.min())) if x.size else 0


class Books:
    """The entries of each part position, how far each has moved, and half the way to its nearest neighbour."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries  # part, entry, position
        n = entries.shape[1]
        moved = np.zeros(entries.shape[:2], np.int64) if before is None else roots_up(squared(entries, before))
        self.moved = moved
        self.others = np.zeros_like(moved)  # the furthest that any other entry has moved
        self.half = np.full(moved.shape, FAR, np.int64)
        for e in range(n):
            rest = [i for i in range(n) if i != e]
            if rest:
                self.others[:, e] = moved[:, rest].max(axis=1)
                self.half[:, e] = roots(squared(entries[:, rest], entries[:, e : e + 1]).min(axis=1)) // 2

    def assign(self, x: np.ndarray, code: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The codes and bounds of the vectors ``x`` (row, part, position), and how many parts were scanned."""
        n, scans = len(x), 0
        out = np.zeros((3, n, PARTS), np.int64)
        for j in range(PARTS):
            entries = self.entries[j]
            if code is None:
                a, u, low = (np.zeros(n, np.int64) for _ in range(3))
                todo = np.arange(n)
            else:
                a = code[:, j].copy()
                u, low = upper[:, j] + self.moved[j, a], np.maximum(lower[:, j] - self.others[j, a], 0)
                safe = np.maximum(low, self.half[j, a])
                loose = np.flatnonzero(u >= safe)
                u[loose] = roots_up(squared(x[loose, j], entries[a[loose]]))
                todo = loose[u[loose] >= safe[loose]]
            if len(todo):
                scans += len(todo)
                part = x[todo, j]
                d = np.stack([squared(part, e) for e in entries], axis=1)
                a[todo] = d.argmin(axis=1)
                u[todo] = roots_up(d.min(axis=1))
                low[todo] = roots(np.sort(d, axis=1)[:, 1]) if len(entries) > 1 else FAR
            out[:, :, j] = a, u, low
        return *out, scans

    def errors(self, x: np.ndarray, code: np.ndarray) -> list[int]:
        """The squared distances of each vector's parts to their entries, summed."""
        total = sum(squared(x[:, j], self.entries[j, code[:, j]]).astype(object) for j in range(PARTS))
        return [min(int(v), MOST) for v in total]

    def renewed(self, totals: list[int]) -> Books:
        """The next codebooks, from the sums of the parts of each entry and their numbers, as ``Sums`` has them."""
        parts, n, width = self.entries.shape
        by = np.array(totals, object).reshape(parts, n, width + 1)
        new = self.entries.copy()
        for j in range(parts):
            for e in range(n):
                if times := int(by[j, e, -1]):
                    new[j, e] = [int(v) // times for v in by[j, e, :-1]]
        return Books(new, self.entries)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


class Sums:
    """For each part and entry the sum of its parts by position, and last their number."""

    def __init__(self, shape: tuple[int, int, int]):
        self.shape = (*shape[:2], shape[2] + 1)
        self.total, self.bound = np.zeros(self.shape, np.int64), 0

    def add(self, x: np.ndarray, code: np.ndarray) -> Iterator[list[int]]:
        """Adds some vectors; gives out what there is before 64 bits could be too few."""
        more = len(x) * max(1, _size(x))
        if self.bound + more > MOST:
            yield from self.out()
        self.bound += more
        for j in range(PARTS):
            np.add.at(self.total[j, :, :-1], code[:, j], x[:, j])
            np.add.at(self.total[j, :, -1], code[:, j], 1)

    def out(self) -> Iterator[list[int]]:
        if self.bound:
            yield self.total.ravel().tolist()
        self.total[:], self.bound = 0, 0


def _lists(x: np.ndarray) -> pa.Array:
    n, width = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(x.ravel(), pa.int64()))


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _round(state: DataFrame, books: Books, started: bool) -> DataFrame:
    """The next state: every vector's codes and bounds, and in rows of their own the sums of each task."""
    shared = state.sparkSession.sparkContext.broadcast(books)
    parts, n, width = books.entries.shape
    longs = ArrayType(LongType(), False)
    schema = StructType([*(state.schema[c] for c in ("id", "label", "ints")), *(StructField(c, longs) for c in ("code", "upper", "lower", "sums"))])
    schema["ints"].nullable = True

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums, types = shared.value, Sums((parts, n, width)), None
        for whole in batches:
            types = [whole.schema.field(i).type for i in range(3)]
            for batch in pieces(whole, "ints"):
                x = _matrix(batch, "ints").reshape(batch.num_rows, PARTS, width)
                code, upper, lower, _ = own.assign(x, *((_matrix(batch, c) for c in ("code", "upper", "lower")) if started else (None, None, None)))
                for total in sums.add(x, code):
                    yield row(total, types)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *map(_lists, (code, upper, lower)), pa.nulls(len(x), pa.list_(pa.int64()))], names=schema.names)
        for total in sums.out():
            yield row(total, types)

    def row(total: list[int], types: list[pa.DataType]) -> pa.RecordBatch:
        none = [pa.nulls(1, t) for t in types] + [pa.nulls(1, pa.list_(pa.int64()))] * 3
        return pa.RecordBatch.from_arrays([*none, pa.array([total], pa.list_(pa.int64()))], names=schema.names)

    return in_arrow(state.select(*schema.names[:6]) if started else state, work, schema)


def _coded(state: DataFrame, books: Books, started: bool) -> DataFrame:
    """(id, label, code, error) with the last codebooks."""
    shared = state.sparkSession.sparkContext.broadcast(books)
    width = books.entries.shape[2]
    schema = StructType([state.schema["id"], state.schema["label"], StructField("code", StringType()), StructField("error", LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for batch in pieces(whole, "ints"):
                x = _matrix(batch, "ints").reshape(batch.num_rows, PARTS, width)
                code = own.assign(x, *((_matrix(batch, c) for c in ("code", "upper", "lower")) if started else (None, None, None)))[0]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([bytes(c).hex() for c in code.astype(np.uint8)]), pa.array(own.errors(x, code), pa.int64())], names=schema.names)

    return in_arrow(state.drop("sums"), work, schema)


def codes(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Books | None]:
    """(id, label, code, error) of every usable vector, and the codebooks.

    A vector that is null, empty or has a null or non-finite component is left out, and so is
    one of another length than that of the smallest id, which must be a multiple of
    eight.  Components beyond 2^40 in size count as that, and an error beyond a long as
    its largest value.  The first entries are the parts of the smallest ids, null ids
    last and equal ids by their vectors; fewer vectors than ``entries`` make fewer.
    Repeated rows each have their row; an empty table gives none, and no codebooks.
    """
    spark = vectors.sparkSession
    x = F.col("v")
    whole = vectors.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    held = F.transform(x, lambda c: F.floor(F.greatest(F.least(c, F.lit(LARGEST)), F.lit(-LARGEST)) * SCALE))
    state = whole.where((F.size(x) > 0) & ~bad).select("id", "label", held.alias("ints"))
    first = [r["ints"] for r in state.orderBy(F.col("id").asc_nulls_last(), "ints").limit(entries).collect()]
    if not first:
        return state.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None
    length = len(first[0])
    if length % PARTS:
        raise ValueError(f"vectors of {length} components can't be cut into {PARTS} equal parts")
    state = state.where(F.size("ints") == length)
    if any(len(v) != length for v in first):
        first = [r["ints"] for r in state.orderBy(F.col("id").asc_nulls_last(), "ints").limit(entries).collect()]
    books = Books(np.array(first, np.int64).reshape(len(first), PARTS, length // PARTS).transpose(1, 0, 2).copy())
    last = ""
    for k in range(rounds):
        path = scratch_path(spark, "codes")
        table = cut_table(_round(state, books, k > 0), "codes", path)
        if last:
            remove(spark, last)
        totals = table.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
        books = books.renewed([r["x"] for r in sorted(totals, key=lambda r: r["at"])])
        state, last = table.where("sums is null"), path
    out = cut_table(_coded(state, books, rounds > 0), "coded")
    if last:
        remove(spark, last)
    return out, books


def op12(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of ``embeddings``; rows without a usable vector are left out."""
    rows, books = codes(vectors)
    by = rows.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    by = F.broadcast(by) if by.count() <= LABELS_SENT else by
    met = rows.join(by, F.col("label").eqNullSafe(F.col("of")))
    return met.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.digest() if books else hashlib.sha256().hexdigest()).alias("codebooks_sha256"))
