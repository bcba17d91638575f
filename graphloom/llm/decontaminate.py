"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ``width`` consecutive words.  A window is the set
of its shingles of SHINGLE words.  A document contains the window only if it has all
of its shingles; ordered by their rarity over all documents, the first one, the
rarest, is all the prefix that full containment needs, and a window of which any
shingle is nowhere can't occur.  Documents and windows meet in a join on the
prefix shingle.  Its place in the window gives the one place where the window could
start; it must fit in the document there (positional and length bounds), and its
words are then compared one by one.

Windows, frequencies and prefixes are Spark tables.  Only filters of a bounded size
are broadcast, which keep most shingles that would meet nothing out of the joins.
What is found depends on the text alone, so equal texts are looked up once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import cut, cut_table
from .batches import in_arrow, pieces, placed, without
from .bitmaps import key_filter, maybe
from .hash_array import Hashes

#: Words of a shingle; a window of fewer is one shingle.
SHINGLE = 5
#: A-Z to a-z, digits and letters and bytes over 7F as they are, the rest to the space: on UTF-8 bytes.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
NEW = ["n_words", "hit_spans", "items"]
#: Keys of hit texts that are broadcast, of 16 bytes each; more are joined by a shuffle.
HIT_SENT = 500_000
MIX = np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORDS).split() if text else []


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` of the words' hashes."""
    n = max(0, len(words) - size + 1)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out ^ (out >> np.uint64(29))) * MIX + words[k : n + k]
    return (out ^ (out >> np.uint64(32))) * MIX


class Found:
    """The words of some texts in a row, and which of their shingles a filter has."""

    def __init__(self, texts: list[str | None], hashes: Hashes):
        self.words = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in self.words])
        self.starts = np.cumsum(sizes) - sizes
        self.hashes = np.concatenate([hashes.of(w) for w in self.words]) if sizes.sum() else np.zeros(0, np.uint64)
        self.docs = np.repeat(np.arange(len(texts)), sizes)

    def hits(self, size: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the row, and hashes."""
        found = shingles(self.hashes, size)
        at = np.flatnonzero(maybe(bits, found))
        at = at[self.docs[at] == self.docs[at + size - 1]]
        return at, found[at]


def windows(benchmark: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(window, item), and (window, n, place, h) for each shingle of each different window; of (item, text)."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1):
                for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    words = [w.decode() for w in words_of(text)]
                    for at in range(0, max(1, len(words) - width + 1) if words else 0, 10_000):
                        found = [" ".join(words[i : i + width]) for i in range(at, min(at + 10_000, max(1, len(words) - width + 1)))]
                        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([item] * len(found), pa.string())], names=["window", "item"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            out = []
            for window in batch.column(0).to_pylist():
                own = hashes.of(window.encode().split(b" "))
                for place, h in enumerate(shingles(own, min(SHINGLE, len(own))).view(np.int64).tolist()):
                    out.append((window, len(own), place, h))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["window", "n", "place", "h"])

    owners = cut(in_arrow(benchmark, runs, "window string, item string").distinct())
    return owners, cut(in_arrow(owners.select("window").distinct(), split, "window string, n int, place int, h long"))


def frequencies(docs: DataFrame, sizes: list[int], bits) -> DataFrame:
    """(h, c): how often each shingle that the filter has occurs in all texts; each task sums its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for whole in batches:
            for batch in pieces(whole, 0):
                own = Found(batch.column(0).to_pylist(), hashes)
                h, c = np.unique(np.concatenate([own.hits(s, bits.value)[1] for s in sizes]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

    return in_arrow(docs.select("text"), count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def prefixes(parts: DataFrame, frequency: DataFrame) -> DataFrame:
    """(window, n, place, h): the rarest shingle of each window whose shingles all occur."""
    by = parts.join(frequency, "h").groupBy("window", "n").agg(F.min(F.struct("c", "h", "place")).alias("m"), F.count(F.lit(1)).alias("k"))
    return by.where(F.col("k") == F.col("n") - F.least(F.col("n"), F.lit(SHINGLE)) + 1).select("window", "n", "m.place", "m.h")


def candidates(docs: DataFrame, sizes: list[int], bits, width: int) -> DataFrame:
    """(k1, k2, n_words, at, h, low, words): for each text a row with its words' number, and one for each of its shingles that the filter has.

    ``words`` are those from ``low`` on that a window with that shingle could have.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for whole in batches:
            for batch in pieces(whole, 2):
                own = Found(batch.column(2).to_pylist(), hashes)
                k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                counts = np.array([len(w) for w in own.words])
                rows = [(i, -1, 0, 0, []) for i in range(len(counts))]
                for s in sizes:
                    for at, h in zip(*(x.tolist() for x in own.hits(s, bits.value)), strict=True):
                        i = int(own.docs[at])
                        p = at - int(own.starts[i])
                        low = max(0, p + s - width)
                        rows.append((i, p, h, low, [w.decode() for w in own.words[i][low : p + width]]))
                for a in range(0, len(rows), 5_000):
                    part = rows[a : a + 5_000]
                    doc = np.array([r[0] for r in part])
                    h = np.array([r[2] for r in part], np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(k1[doc]), pa.array(k2[doc]), pa.array(counts[doc]), pa.array([r[1] for r in part], pa.int64()), pa.array(h), pa.array([r[3] for r in part], pa.int64()), pa.array([r[4] for r in part], pa.list_(pa.string()))], names=["k1", "k2", "n_words", "at", "h", "low", "words"])

    return in_arrow(docs.select("k1", "k2", "text"), find, "k1 long, k2 long, n_words long, at long, h long, low long, words array<string>")


def lookup(docs: DataFrame, benchmark: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(k1, k2, n_words, ...) of every text, (k1, k2, start, end, window) of every occurrence of a window, and (window, item).

    ``docs`` has k1, k2 and text; ``benchmark`` has item and text.
    """
    sc = docs.sparkSession.sparkContext
    owners, parts = windows(benchmark.where("item is not null and text is not null"), width)
    sizes = sorted(r[0] for r in parts.select(F.least(F.col("n"), F.lit(SHINGLE))).distinct().collect()) or [SHINGLE]  # SHINGLE at most
    every = sc.broadcast(key_filter(parts.select("h").distinct(), F.col("h")))
    prefix = cut(prefixes(parts, frequencies(docs, sizes, every)))
    every.destroy()
    first = sc.broadcast(key_filter(prefix.select("h").distinct(), F.col("h")))
    found = cut_table(candidates(docs, sizes, first, width), "candidates")
    first.destroy()
    met = found.where("at >= 0").dropDuplicates(["k1", "k2", "at", "h"]).join(prefix, "h").withColumn("start", F.col("at") - F.col("place"))
    fits = (F.col("start") >= F.col("low")) & (F.col("start") + F.col("n") <= F.col("low") + F.size("words"))
    same = F.array_join(F.slice("words", (F.col("start") - F.col("low") + 1).cast("int"), F.col("n")), " ") == F.col("window")
    hits = cut_table(met.where(fits).where(same).select("k1", "k2", "start", (F.col("start") + F.col("n")).alias("end"), "window"), "hits")
    return found, hits, owners


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """A text's key is two hashes of it; a null one has that of the empty text."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"k1": F.xxhash64(t), "k2": F.xxhash64(F.lit(1), t)})


def _named(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    return benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text"))


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` and n_words, hit_spans (word positions: start, end, start, end, ...) and items (ids as sorted strings).

    Null and empty texts have no words and no hits.  An item of fewer than ``width``
    words, but not none, is one window; items without words, and items whose id is
    null, have none.  Equal items are all named.  Rows of ``docs`` are neither
    dropped nor merged, and an empty table gives none; without items nothing is hit.
    Columns of the new names, whatever their case, are replaced.
    """
    own, (t,) = placed(docs, text)
    own = _keyed(own, t)
    found, hits, owners = lookup(own.select("k1", "k2", F.col(t).alias("text")), _named(benchmark, item_id, item_text), width)
    by = Window.partitionBy("k1", "k2").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = hits.select("k1", "k2", "start", "end").distinct().withColumn("new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    islands = islands.withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy("k1", "k2", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = islands.groupBy("k1", "k2").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "end"))), lambda x: F.array(x["start"], x["end"]))).alias("hit_spans"))
    who = hits.select("k1", "k2", "window").distinct().join(owners, "window").groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    sizes = found.groupBy("k1", "k2").agg(F.max("n_words").alias("n_words"))
    results = sizes.join(spans, ["k1", "k2"], "left").join(who, ["k1", "k2"], "left")
    results = results.select(F.col("k1").alias("of1"), F.col("k2").alias("of2"), "n_words", *[F.coalesce(c, F.array().cast(k)).alias(c) for c, k in (("hit_spans", "array<long>"), ("items", "array<string>"))])
    kept = [i for i, c in enumerate(docs.columns) if without([c], NEW)]
    out = own.join(results, (F.col("k1") == F.col("of1")) & (F.col("k2") == F.col("of2"))).select(*[f"c{i}" for i in kept], *NEW)
    return out.toDF(*[docs.columns[i] for i in kept], *NEW)


def op5(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contaminated(docs.select("doc_id", "text"), benchmark)
    n_hit = F.expr("aggregate(hit_spans, 0L, (acc, x) -> x - acc)")  # ends less starts: the signs alternate over an even count
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any window of the benchmark, with all of their columns; repeated rows stay or go together."""
    own, (t,) = placed(docs, text)
    own = _keyed(own, t)
    _, hits, _ = lookup(own.select("k1", "k2", F.col(t).alias("text")), _named(benchmark, "item_id", "text"), 10)
    hit = cut(hits.select("k1", "k2").distinct())
    hit = F.broadcast(hit) if hit.count() <= HIT_SENT else hit
    return own.join(hit, ["k1", "k2"], "left_anti").select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)
