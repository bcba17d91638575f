"""SimHash near-duplicates by a segment-popcount embedding.

Each fingerprint is cut into 32 segments of two bits and mapped to the number of
set bits in each.  The Manhattan distance of two such points never exceeds the
Hamming distance of the fingerprints, so it bounds the candidates from below.
Written in unary, a segment's count takes two bits (0: 00, 1: 01, 2: 11), hence
the whole point fits one long and the Manhattan distance is a popcount of an XOR.

The grid has cells of side one: the axes form B blocks, and points within distance
three agree on at least B - 3 of them, so they meet in one of the cells given by B - 3
blocks.  More blocks make more and smaller cells; B follows the number of
fingerprints so that each is compared with few others by chance.  A pair is kept in
the first such cell only, the join checks both distances inside its condition, and
links are between distinct fingerprints: copies never meet in a join.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from ..operators.components import components
from ..plans.lineage import cut
from .batches import map_text, placed

#: A-Z to a-z and all ASCII white space to the space, on UTF-8 bytes.
LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
LANES = np.uint64(0x0101010101010101)
RUN = 255  # values that one lane of eight bits can count
#: Blocks of the grid to choose from.
BLOCKS = (6, 8, 10, 12)
#: The chance that two random segments have the same count.
ALIKE = 0.375
EVEN = 0x5555555555555555


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The signed 64-bit fingerprint of a text; zero for one without words.

    Shingles are ``width`` words joined by a space, repeats included; a text of
    fewer words is one shingle.  A bit is set if more than half of the shingles'
    XXH64 values have it.
    """
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split(b" ") if text else []
    words = [w for w in words if w]
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)
    n = len(hashes)
    padded = np.zeros(-(-n // RUN) * RUN, np.uint64)
    padded[:n] = hashes
    counts = np.empty(64, np.int64)
    for shift in range(8):
        lanes = ((padded >> np.uint64(shift)) & LANES).reshape(-1, RUN).sum(axis=1, dtype=np.uint64)
        counts[shift::8] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n, bitorder="little").view(np.int64)
    return int(bits[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """``docs`` and the fingerprint of each whole text, as a signed long."""
    return map_text(docs, text, [StructField(out, LongType(), False)], lambda texts: [[fingerprint(t) for t in texts]])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def embedding(fp: str) -> F.Column:
    """The popcounts of 32 two-bit segments, each in unary."""
    x, half = F.col(fp), F.shiftrightunsigned(fp, 1)
    low = F.lit(EVEN)
    return x.bitwiseOR(half).bitwiseAND(low).bitwiseOR(F.shiftleft(x.bitwiseAND(half).bitwiseAND(low), 1))


def _axes(blocks: int) -> list[int]:
    return [sum(3 << (2 * axis) for axis in range(32) if axis * blocks // 32 == b) for b in range(blocks)]


def cells(blocks: int, most: int = 3) -> list[int]:
    """Bit masks of the axes of each grid: all but ``most`` of the blocks."""
    axes = _axes(blocks)
    return [_signed(sum(axes[b] for b in kept)) for kept in combinations(range(blocks), blocks - most)]


def blocks_for(n: int, most: int = 3) -> int:
    """The fewest blocks with which a fingerprint of ``n`` random ones meets less than one other by chance."""
    for blocks in BLOCKS:
        meets = sum(ALIKE ** (m.bit_count() / 2) for m in (c % (1 << 64) for c in cells(blocks, most)))
        if meets * n < 1:
            return blocks
    return BLOCKS[-1]


def links(distinct: DataFrame, most: int = 3, blocks: int | None = None) -> DataFrame:
    """Pairs (a, b) of the ``rep`` of fingerprints at ``most`` or fewer differing bits.

    ``distinct``: one row (fp, rep) for each fingerprint.  ``most`` is 3 or less.
    """
    blocks = blocks or blocks_for(distinct.count(), most)
    masks = cells(blocks, most)
    point = distinct.select("fp", "rep", embedding("fp").alias("at"))
    keyed = point.select("fp", "rep", "at", F.posexplode(F.array(*[F.col("at").bitwiseAND(F.lit(m)) for m in masks])).alias("grid", "cell"))
    a, b = keyed.alias("a"), keyed.alias("b")
    apart = F.col("a.at").bitwiseXOR(F.col("b.at"))
    axes = [_signed(m) for m in _axes(blocks)]
    alike = sum((F.when(apart.bitwiseAND(F.lit(m)) == 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, m in enumerate(axes)), F.lit(0))
    kept = [sum(1 << i for i in c) for c in combinations(range(blocks), blocks - most)]
    first = [next((g for g, c in enumerate(kept) if c & m == c), -1) for m in range(1 << blocks)]  # by the blocks that agree
    earlier = F.get(F.split(F.lit(",".join(map(str, first))), ",").cast("array<int>"), alike)
    met = (
        (F.col("a.grid") == F.col("b.grid"))
        & (F.col("a.cell") == F.col("b.cell"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (F.bit_count(apart) <= most)
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= most)
        & (earlier == F.col("a.grid"))
    )
    return a.join(b, met).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", most: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): the smallest id that a chain of links reaches.

    Every row gives a row.  Rows without an id take part in no link, but share the
    component of an equal fingerprint; where no row with an id has it, null.
    Texts that are null or without words have fingerprint zero, linked like any
    other; copied rows each count as a row.  An empty table gives none.
    """
    prints = cut(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text").drop("text"))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(links(distinct.where("rep is not null"), most))
    placed = distinct.join(found, distinct["rep"] == found["id"], "left").select(distinct["fp"].alias("own"), F.coalesce("component", "rep").alias("component_id"))
    return prints.join(placed, F.col("fp") == F.col("own")).select("doc_id", "fp", "component_id")


def op7(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near_duplicates(docs).select("doc_id", hexed.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component; rows without an id stay.

    Repeated rows with that same id all stay, and columns stay as they are.
    """
    own, (t, d) = placed(docs, text, doc_id)
    kept = near_duplicates(own, t, d).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__kept")).distinct()
    return own.join(kept, F.col(d) == F.col("__kept"), "left").where(F.col("__kept").isNotNull() | F.col(d).isNull()).drop("__kept").toDF(*docs.columns)
