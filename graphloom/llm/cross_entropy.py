"""Cross-entropy difference between a target and a background bigram model.

Both models have one vocabulary, order and smoothing; the target is counted on
the documents with a label, the background on all others.  The vocabulary is
every word of all documents, and every bigram of them counts, so what is gathered
grows with the corpus.  Words are keyed by XXH64 and bigrams by a mix of two such
hashes.

The smoothing is a hierarchical Dirichlet one: a word's probability is
``p(w) = (c(w) + PRIOR) / (N + PRIOR V)``, and after ``v`` it is
``(c(v, w) + MASS p(w)) / (c(v) + MASS)``; what is left is the end of a text, which
isn't scored.  A document never scores itself: its own words and bigrams are taken
out of the counts of the model that it belongs to.  So what occurs in one document
only is unknown there and nowhere else asked for.

The logarithm falls into a part for each word, as it stands and as it precedes
another, and one for each bigram that is known from elsewhere.  Documents are dealt
into blocks of about BLOCK_BYTES of text.  A block asks for each of its distinct
words and bigrams once, with its own counts: their keys, in order, are cut into the
same ranges for all blocks, and each range of a block is one row of packed arrays.
The task of a range adds up what all blocks say and answers each with the totals, in
the order of its keys.  The block then scores its documents.  So no row is made for
a bigram of a document, a frequent key comes once from each block, and no task holds
more than a block or a range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .batches import BATCH_BYTES, placed, without
from .hash_array import Hashes
from .simhash import LOWER

PRIOR, MASS = 0.5, 8.0
#: Bytes of text for each block of documents and each range of keys.
BLOCK_BYTES, RANGE_BYTES = 8_000_000, 16_000_000
#: Nothing reads these; they were the bounds of what was broadcast, and a test sets them.
HOT_WORDS, HOT_GRAMS = 1 << 20, 1 << 21
#: Ids of target documents that are broadcast; more are joined by a shuffle.
TARGETS_SENT = 2_000_000
NEW = ["n_words", "ce_target", "ce_background", "ce_diff"]
CODEC = "zstd"
#: Of a block: tokens of target documents and of others, and such documents with words.
SUMS = ["nt", "nb", "dt", "db"]
INT, LONG, DOUBLE, BINARY = pa.int32(), pa.int64(), pa.float64(), pa.binary()
ASKED = pa.schema({"range": INT, "block": INT, "words": INT, "grams": INT, "keys": BINARY, "counts": BINARY, **dict.fromkeys(SUMS, LONG)})
TOLD = pa.schema({"block": INT, "range": INT, "check": LONG, "totals": BINARY, "v": LONG, **dict.fromkeys(SUMS, LONG)})
SCORED = pa.schema({"key": LONG, "n_words": LONG, **dict.fromkeys(NEW[1:], DOUBLE)})


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def after(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The hash of bigrams; the start of a text is a first word of hash 0."""
    return ((first << np.uint64(1)) | (first >> np.uint64(63))) ^ second


def packed(*parts: np.ndarray) -> bytes:
    """64-bit whole numbers, compressed by the lowest bytes of all, then the next: small ones take little room."""
    data = np.concatenate(parts).view(np.uint8).reshape(-1, 8).T.tobytes()
    return pa.compress(data, CODEC, asbytes=True) if data else b""


def unpacked(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(data, n * 8, CODEC, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).reshape(-1).view(np.int64)


def steps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as their differences, the first as it is."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.int64)


class Grouped:
    """The distinct keys of a block in order, and the pairs of a text and a key.

    Of each pair: its text, the place of its key, a place where it stands, and how
    often it does; ``which`` is the pair of each place.
    """

    def __init__(self, keys: np.ndarray, docs: np.ndarray, n_docs: int):
        order = np.argsort(keys)
        k = keys[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        self.keys = k[new]
        at = np.empty(len(k), np.int32)
        at[order] = np.cumsum(new, dtype=np.int32) - 1
        # Equal keys of a text together; the sort by 16 bits is linear.
        order = order[np.argsort(docs[order].astype(np.uint16 if n_docs <= 1 << 16 else np.int64), kind="stable")]
        a, d = at[order], docs[order]
        new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
        starts = np.flatnonzero(new)
        self.at, self.docs, self.place = a[starts], d[starts], order[starts]
        self.times = np.diff(starts, append=len(k))
        self.which = np.empty(len(k), np.int32)
        self.which[order] = np.cumsum(new, dtype=np.int32) - 1

    def counts(self, chosen: np.ndarray) -> np.ndarray:
        """How often each key stands in the texts that are chosen."""
        return np.bincount(self.at, self.times * chosen[self.docs], len(self.keys)).astype(np.int64)


class Block:
    """The words and bigrams of the texts of a block."""

    def __init__(self, table: pa.Table, hashes: Hashes):
        found = [hashes.of(words_of(t.as_py())) for t in table.column("text")]
        n = len(found)
        self.sizes = np.fromiter(map(len, found), np.int64, n)
        self.target = table.column("target").to_numpy().astype(bool)
        words = np.concatenate(found)
        del found
        docs = np.repeat(np.arange(n, dtype=np.int32), self.sizes)
        ends = np.cumsum(self.sizes)[self.sizes > 0]
        before = np.zeros(len(words), np.uint64)
        before[1:] = words[:-1]
        before[(ends - self.sizes[self.sizes > 0])] = 0
        self.words, self.grams = Grouped(words, docs, n), Grouped(after(before, words), docs, n)
        #: How often another word follows, of each pair of words; the word that ends each pair of bigrams.
        self.follows = self.words.times.copy()
        self.follows[self.words.which[ends - 1]] -= 1
        self.second = self.words.which[self.grams.place]

    def sums(self) -> list[int]:
        some = self.sizes > 0
        return [int(x) for x in (self.sizes[self.target].sum(), self.sizes[~self.target].sum(), (some & self.target).sum(), (some & ~self.target).sum())]

    def ranges(self, n: int) -> list[tuple[slice, slice]]:
        """Of each of ``n`` equal ranges of keys the words and bigrams."""
        edges = np.array([(i << 64) // n for i in range(n)], np.uint64)
        bounds = [[*np.searchsorted(g.keys, edges).tolist(), len(g.keys)] for g in (self.words, self.grams)]
        return list(zip(*([slice(i, j) for i, j in zip(b, b[1:], strict=False)] for b in bounds), strict=True))

    def check(self, w: slice, g: slice) -> int:
        """A checksum of some keys."""
        return int(np.bitwise_xor.reduce(np.concatenate((self.words.keys[w], ~self.grams.keys[g]))).view(np.int64))


def _asked(blocks: DataFrame, n: int) -> DataFrame:
    """Of each block and each of the ``n`` ranges of keys one row with the distinct keys and their counts."""
    hashes = Hashes()

    def work(table: pa.Table) -> pa.Table:
        own = Block(table, hashes)
        rows, sums = [], dict(zip(SUMS, own.sums(), strict=True))
        if own.sizes.any():
            block = table.column("block")[0].as_py()
            wc, gc = ([x.counts(own.target), x.counts(~own.target)] for x in (own.words, own.grams))
            for i, (w, g) in enumerate(own.ranges(n)):
                wkeys, gkeys = own.words.keys[w], own.grams.keys[g]
                counts = packed(*(x for k in (0, 1) for x in (wc[k][w], gc[k][g])))
                rows.append({"range": i, "block": block, "words": len(wkeys), "grams": len(gkeys), "keys": packed(steps(wkeys), steps(gkeys)), "counts": counts, **sums})
        return pa.Table.from_pylist(rows, ASKED)

    return blocks.groupBy("block").applyInArrow(work, from_arrow_schema(ASKED))


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[int, np.ndarray]:
    """How many distinct keys there are, and in place of the two counts of each the totals of its key."""
    every = np.concatenate(keys)
    order = np.argsort(every)
    k = every[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    out = np.empty((2, len(k)), np.int64)
    if len(k):
        at = np.cumsum(new, dtype=np.int32) - 1
        for i in (0, 1):
            out[i, order] = np.add.reduceat(np.concatenate([c[i] for c in counts])[order], starts)[at]
    return len(starts), out


def _told(asked: DataFrame) -> DataFrame:
    """The totals of each row of ``asked``, in the order of its keys, and the sums of all blocks."""

    def work(table: pa.Table) -> pa.Table:
        sizes = [table.column(c).to_numpy() for c in ("words", "grams")]
        keys, counts = ([], []), ([], [])
        for w, g, k, c in zip(*sizes, table.column("keys"), table.column("counts"), strict=True):
            found, both = unpacked(k.as_py(), w + g).view(np.uint64), unpacked(c.as_py(), 2 * (w + g)).reshape(2, -1)
            for i, p in enumerate((slice(0, w), slice(w, w + g))):
                keys[i].append(np.cumsum(found[p], dtype=np.uint64))
                counts[i].append(both[:, p])
        checks = [int(np.bitwise_xor.reduce(np.concatenate((a, ~b))).view(np.int64)) if len(a) + len(b) else 0 for a, b in zip(*keys, strict=True)]
        (v, words), (_, grams) = (_added(k, c) for k, c in zip(keys, counts, strict=True))
        ends = [np.concatenate(([0], np.cumsum(s))) for s in sizes]
        totals = [packed(*(x[k, e[i] : e[i + 1]] for k in (0, 1) for x, e in zip((words, grams), ends, strict=True))) for i in range(table.num_rows)]
        n = table.num_rows
        sums = [pa.array(np.full(n, int(table.column(c).to_numpy().sum()))) for c in SUMS]
        return pa.Table.from_arrays([table.column("block"), table.column("range"), pa.array(checks, pa.int64()), pa.array(totals, pa.binary()), pa.array(np.full(n, v)), *sums], schema=TOLD)

    return asked.groupBy("range").applyInArrow(work, from_arrow_schema(TOLD))


def _scored(blocks: DataFrame, told: DataFrame, n: int) -> DataFrame:
    """The key of each document, its number of words and its scores."""
    hashes = Hashes()

    def work(table: pa.Table, told: pa.Table) -> pa.Table:
        own = Block(table, hashes)
        keys, sizes = table.column("key"), own.sizes
        none = [None] * len(sizes)
        if not sizes.any():
            return pa.Table.from_arrays([keys, pa.array(sizes), *[pa.array(none, pa.float64())] * 3], schema=SCORED)
        of_words, of_grams = np.zeros((2, len(own.words.keys))), np.zeros((2, len(own.grams.keys)))
        ranges = own.ranges(n)
        if sorted(told.column("range").to_pylist()) != list(range(n)):
            raise RuntimeError("a block of documents was not told of every range of keys")
        for i, check, data in zip(*map(told.column, ("range", "check", "totals")), strict=True):
            w, g = ranges[i.as_py()]
            words = w.stop - w.start
            size = words + g.stop - g.start
            if size and own.check(w, g) != check.as_py():
                raise RuntimeError("a block of documents changed while its words were counted")
            found = unpacked(data.as_py(), 2 * size).reshape(2, -1)
            of_words[:, w], of_grams[:, g] = found[:, :words], found[:, words:]
        symbols = max(1, sum(told.column("v").to_pylist()))
        tokens, docs = ([told.column(f"{c}{k}")[0].as_py() for k in "tb"] for c in "nd")
        words, grams = own.words, own.grams
        ce = []
        for k, mine in enumerate((own.target, ~own.target)):
            minus = mine.astype(np.float64)  # a document's own counts are taken out
            den = tokens[k] - minus * sizes + PRIOR * symbols
            sums = sizes * (np.log2(PRIOR) - np.log2(den)) + np.where(sizes > 0, np.log2(MASS) - np.log2(docs[k] - minus * (sizes > 0) + MASS), 0.0)
            left = of_words[k][words.at] - minus[words.docs] * words.times
            sums += np.bincount(words.docs, words.times * np.log2(left / PRIOR + 1) - own.follows * np.log2(left / MASS + 1), len(sizes))
            left, ends = of_grams[k][grams.at] - minus[grams.docs] * grams.times, left[own.second]
            sums += np.bincount(grams.docs, grams.times * np.log2(left * den[grams.docs] / (MASS * (ends + PRIOR)) + 1), len(sizes))
            ce.append(-sums / np.maximum(sizes, 1))
        empty = sizes == 0
        return pa.Table.from_arrays([keys, pa.array(sizes), *(pa.array(x, mask=empty) for x in (ce[0], ce[1], ce[0] - ce[1]))], schema=SCORED)

    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(work, from_arrow_schema(SCORED))


def score(docs: DataFrame, targets: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` and n_words, ce_target, ce_background and ce_diff, in bits a word; a low difference is like the target.

    ``targets`` has the ids of the target documents in the column ``doc_id``; ids
    that no document has, nulls and repeats don't matter.  Without any target, or
    with none but the document itself, the target model knows only its prior.  A
    text without words, a null one too, has no words and null scores.  Rows are
    neither dropped nor merged: each repeated row is a document of its own, which
    the others know.  An empty table gives none.  Columns of the new names, whatever
    their case, are replaced.
    """
    spark = docs.sparkSession
    own, names = placed(docs, text, doc_id)
    t, d = map(F.col, names)
    ids = targets.select(F.col("doc_id").alias("__target")).where("__target is not null").distinct()
    ids = F.broadcast(ids) if ids.count() <= TARGETS_SENT else ids
    keyed = own.withColumn("__key", F.xxhash64(d, t))
    size = own.agg(F.sum(F.octet_length(t))).first()[0] or 0
    n, ranges = max(1, -(-size // BLOCK_BYTES)), max(1, -(-size // RANGE_BYTES))
    # Repeated rows share a key; those of different partitions go to different blocks.
    block = F.pmod(F.xxhash64("key", "at"), F.lit(n)).cast("int")
    marked = keyed.join(ids, d == F.col("__target"), "left").select(F.col("__key").alias("key"), F.spark_partition_id().alias("at"), F.col("__target").isNotNull().alias("target"), t.alias("text"))
    # Both readers of the blocks are the same plan, so Spark deals them once.
    blocks = marked.select(block.alias("block"), "key", "target", "text").repartitionById(n, "block")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    told = _told(_asked(blocks, ranges).repartitionById(ranges, "range")).repartitionById(n, "block")
    found = _scored(blocks, told, ranges).dropDuplicates(["key"])  # rows of one id and text have the same scores
    kept = [i for i, c in enumerate(docs.columns) if without([c], NEW)]
    out = keyed.join(found, F.col("__key") == F.col("key")).select(*[f"c{i}" for i in kept], *NEW)
    return out.toDF(*[docs.columns[i] for i in kept], *NEW)


def op9(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, ce_target, ce_background, ce_diff: of every document against those labelled of quality."""
    targets = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")
    return score(docs.select("doc_id", "text"), targets).select("doc_id", *NEW)
