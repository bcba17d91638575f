"""Modified Kneser-Ney models over characters, counted and smoothed as Spark tables.

A symbol is a UTF-16 unit as it stands in the text, so a gram of four symbols is
packed into one long and nothing is folded.  Every language has a model of its
own, and every gram of the corpus is in it.

The costs of the hot grams are collected and broadcast as arrays sorted by a hash
of the gram, which are searched.  A gram is hot if it makes up one HOT-th of all
grams of the corpus, so there are HOT of them at most, of all languages together,
with 12 bytes each.  All other grams of a text join the table, where none has
many rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import cut
from .batches import in_arrow, pieces
from .hash_array import HashArray

ORDER, BITS = 4, 16
SYMBOLS = 1 << BITS
#: Hot grams at most.
HOT = 1 << 21
#: Languages whose discounts are broadcast, 40 bytes each.
SLOTS_SENT = 50_000
#: Units of text that are packed at a time, and distinct grams that a task holds before it passes them on.
RUN, HELD = 1 << 20, 1_500_000
START = np.full(ORDER - 1, 10, np.uint16)  # a text starts after line ends


def slot(lang: str) -> F.Column:
    """The name of a language's model; a null is a language of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit(""))


def units(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-16-le", "surrogatepass"), np.uint16)


def runs(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of the texts, RUN units together: whose they are, how long, and their packed grams in a row.

    A text of more than RUN units comes as several stretches.
    """
    owners: list[int] = []
    parts: list[np.ndarray] = []
    lengths: list[int] = []
    held = 0

    def packed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = np.concatenate(parts).astype(np.uint64)
        n = len(flat) - ORDER + 1
        out = np.zeros(n, np.uint64)
        for k in range(ORDER):
            out <<= np.uint64(BITS)
            out |= flat[k : n + k]
        sizes = np.array(lengths)
        if len(sizes) > 1:  # grams that end in what comes before a stretch belong to none
            ends = np.cumsum(sizes + ORDER - 1)[:-1]
            own = np.ones(n, bool)
            for k in range(1, ORDER):
                own[ends - k] = False
            out = out[own]
        return np.array(owners), sizes, out

    for i, text in enumerate(texts):
        u = units(text)
        for at in range(0, len(u), RUN):
            own = u[at : at + RUN]
            parts += [u[at - ORDER + 1 : at] if at else START, own]
            owners.append(i)
            lengths.append(len(own))
            held += len(own)
            if held >= RUN:
                yield packed()
                owners, parts, lengths, held = [], [], [], 0
    if owners:
        yield packed()


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all parts, ascending, and the sums of their counts."""
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[starts], np.add.reduceat(counts, starts)


def count(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(slot, gram, c) over all whole texts; each task sums its own grams first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for s, parts in held.items():
                keys, counts = summed(parts)
                for i in range(0, len(keys), 200_000):
                    k, c = keys[i : i + 200_000], counts[i : i + 200_000]
                    yield pa.RecordBatch.from_arrays([pa.array([s] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(c)], names=["slot", "gram", "c"])
            held.clear()

        for whole in batches:
            for batch in pieces(whole, 1):
                slots = np.array(batch.column(0).to_pylist(), object)
                texts = batch.column(1).to_pylist()
                for s in set(slots.tolist()):
                    for _, _, packed in runs([texts[i] for i in np.flatnonzero(slots == s).tolist()]):
                        keys, counts = np.unique(packed, return_counts=True)
                        held.setdefault(s, []).append((keys, counts.astype(np.int64)))
                        size += len(keys)
                if size > HELD:
                    for s, parts in held.items():
                        held[s] = [summed(parts)]
                    size = sum(len(parts[0][0]) for parts in held.values())
                    if size > HELD // 2:
                        yield from out()
                        size = 0
        yield from out()

    own = docs.select(slot(lang).alias("slot"), F.col(text).alias("text"))
    return in_arrow(own, work, "slot string, gram long, c long").groupBy("slot", "gram").agg(F.sum("c").alias("c"))


def smooth(counts: DataFrame) -> DataFrame:
    """(slot, gram, c, p): the probability of the last symbol of each counted gram after the others.

    The highest order has the counts, each lower one the number of different
    symbols before a gram.  Discounts come from the counts of counts of the slot.
    Each level is written once and read by the next; every gram of the documents is
    in the highest one, so no back-off weight is asked for.
    """
    levels = [counts]
    for k in range(ORDER - 1, 0, -1):
        mask = F.lit((1 << BITS * k) - 1)
        levels.append(cut(levels[-1].groupBy("slot", F.col("gram").bitwiseAND(mask).alias("gram")).agg(F.count(F.lit(1)).alias("c"))))
    levels.reverse()
    n = [F.sum((F.col("c") == i).cast("double")).alias(f"n{i}") for i in range(1, 5)]
    every = reduce(DataFrame.unionAll, [level.select(F.lit(k).alias("k"), "slot", "c") for k, level in enumerate(levels, 1)])
    counts_of = cut(every.groupBy("k", "slot").agg(*n))
    few = counts_of.count() <= ORDER * SLOTS_SENT
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    fit = lambda i: F.when((F.col(f"n{i}") > 0) & (F.col("n1") > 0), F.greatest(F.lit(0.05), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"))).otherwise(F.lit(0.5))
    below: DataFrame | None = None
    for k, level in enumerate(levels, 1):
        discounts = counts_of.where(F.col("k") == k).select(F.col("slot").alias("of"), *[fit(i).alias(f"d{i}") for i in (1, 2, 3)])
        discounts = F.broadcast(discounts) if few else discounts  # a join by the slot alone would give each language one task
        d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.least("d3", F.col("c")))
        known = level.join(discounts, F.col("slot") == F.col("of")).select("slot", "gram", "c", d.alias("d"), F.shiftrightunsigned("gram", BITS).alias("history"))
        over = Window.partitionBy("slot", "history")  # SYMBOLS rows at most
        known = known.withColumn("total", F.sum("c").over(over)).withColumn("freed", F.sum("d").over(over) / F.col("total"))
        own = (F.col("c") - F.col("d")) / F.col("total")
        if below is None:
            p = known.select("slot", "gram", "c", (own + F.col("freed") / SYMBOLS).alias("p"))
        else:
            lower = below.select(F.col("slot").alias("of"), F.col("gram").alias("lower"), F.col("p").alias("under"))
            suffix = F.col("gram").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1))
            p = known.join(lower, (F.col("slot") == F.col("of")) & (suffix == F.col("lower"))).select("slot", "gram", "c", (own + F.col("freed") * F.col("under")).alias("p"))
        below = cut(p)
    return below


class Model:
    """The costs in bits of the hot grams, a hash array for each slot."""

    def __init__(self, arrays: dict[str, HashArray]):
        self.arrays = arrays

    def cost(self, texts: list[str | None], s: str) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of each text the summed bits of its hot grams, and its other grams, with repeats."""
        array = self.arrays.get(s) or HashArray(np.zeros(0, np.uint64), np.zeros(0, np.float32))
        bits = np.zeros(len(texts))
        cold: list[list[np.ndarray]] = [[] for _ in texts]
        for owners, lengths, packed in runs(texts):
            at = array.find(packed)
            value = array.values[0][at]
            starts = np.cumsum(lengths) - lengths
            np.add.at(bits, owners, np.add.reduceat(value, starts, dtype=np.float64))
            missed = np.flatnonzero(at == array.n)
            whose = np.searchsorted(starts, missed, side="right") - 1
            edges = np.searchsorted(whose, np.arange(len(owners) + 1))
            for k, i in enumerate(owners.tolist()):
                if edges[k] < edges[k + 1]:
                    cold[i].append(packed[missed[edges[k] : edges[k + 1]]])
        none = np.zeros(0, np.uint64)
        return bits, [np.concatenate(c) if c else none for c in cold]


def trained(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[Model, DataFrame]:
    """The model of the hot grams, and (slot, gram, bits) of all others."""
    counts = cut(count(docs, text, lang))
    total = counts.agg(F.sum("c")).first()[0] or 0
    costs = smooth(counts).select("slot", "gram", "c", (-F.log2("p")).alias("bits"))
    hot = F.col("c") >= F.lit(total / HOT)
    table = costs.where(hot).select("slot", "gram", F.col("bits").cast("float").alias("bits")).toArrow()
    slots = table.column("slot").combine_chunks().dictionary_encode()
    if isinstance(slots, pa.ChunkedArray):
        slots = slots.combine_chunks()
    codes = slots.indices.to_numpy()
    grams, bits = table.column("gram").to_numpy().view(np.uint64), table.column("bits").to_numpy()
    order = np.argsort(codes, kind="stable")
    edges = np.searchsorted(codes[order], np.arange(len(slots.dictionary) + 1))
    arrays = {s: HashArray(grams[order[a:b]], bits[order[a:b]]) for s, a, b in zip(slots.dictionary.to_pylist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True)}
    return Model(arrays), costs.where(~hot).select("slot", "gram", "bits")
