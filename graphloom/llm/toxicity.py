"""Toxicity scores: boosted trees over dense features of a text, calibrated by isotonic regression.

The lexicon is learned: its entries are words and word beginnings that toxic labelled
documents have far more often than others.  A document that was counted must not see
its own label in it, so the labelled documents fall into two halves, and each half's
features come from the entries of the other; the trees learn on three parts of four
and the calibration on the fourth.  All other documents, held out or not labelled, are
scored with the entries of both halves together.

Words are compared without case, and as they read when digits and signs that stand for
letters are put back and the dots inside are taken out; what that changes counts as
obfuscation.  Learning is bounded by FIT_ROWS, LEXICON and the depth and number of the
trees; scoring is one pass over all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField

from ..plans.lineage import cut_table
from .batches import in_arrow, map_text, pieces, placed, without

#: Labelled documents that the model is fitted on, about so many at most, chosen by the hashes of their ids.
FIT_ROWS = 200_000
#: Entries of the lexicon at most, the best first.
LEXICON = 20_000
#: Candidates for entries whose counts among other documents are taken.
CANDIDATES = 300_000
#: An entry is in so many toxic documents of those counted, and in one 400th of all toxic ones.
LEAST = 3
#: Of an entry's weight, the logarithm of how much likelier a toxic document has it.
WEIGHT, STRONG = math.log(4), math.log(30)
#: Letters of the word beginnings that may be entries.
STARTS = range(3, 9)
#: Characters of a word that are looked at; longer ones are no words.
LONGEST = 64
#: Words between an entry and a second person that is meant.
NEAR = 4
TREES, DEPTH, STEP = 30, 3, 0.25
#: Units that a task counts before it passes them on.
HELD = 200_000

# Words of the second person in the languages of the corpus, and signs read as letters.
SECOND = frozenset("you your yours yourself u ur thou thee thy du dich dir dein deine deinen deiner deinem ihr euch euer eure tu te toi ton ta tes vous votre vos tú ti tuyo tuya usted ustedes vosotros vuestro os".split())
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
INSIDE = re.compile(r"(?<=\w)[.*_\-+~](?=\w)")
FEATURES = ["words", "density", "strong", "distinct", "best", "second", "mean", "beginnings", "person", "persons", "capitals", "shouted", "punctuation", "exclamations", "obfuscated", "obfuscated_hits"]


def read(token: str) -> tuple[str, bool]:
    """A token as it reads, and whether that took more than lower case and the punctuation around it away."""
    if token.isalpha():
        return token.lower(), False
    bare = EDGES.sub("", token).lower()
    if bare.isalpha() and not (token[0] in "$@" and token[1:2].isalpha()):
        return bare, False
    if not bare:
        return "", False
    whole = token.lower().strip(".,;:?\"'()[]{}")
    plain = INSIDE.sub("", whole).translate(SIGNS) if any(c.isalpha() for c in whole) else whole
    plain = EDGES.sub("", plain)
    return (plain, True) if plain.isalpha() and plain != bare else (bare, False)


class Units(dict):
    """The entries that a token may stand for, its word and the beginnings with a hyphen behind; remembered, and of ``only`` those where it is given."""

    def __init__(self, only: frozenset[str] | None = None):
        super().__init__()
        self.only = only

    def __missing__(self, token: str) -> tuple[str, ...]:
        word, _ = read(token)
        found: tuple[str, ...] = ()
        if STARTS[0] <= len(word) <= LONGEST:
            found = (word, *[f"{word[:k]}-" for k in STARTS if k < len(word)])
            if self.only is not None:
                found = tuple(u for u in found if u in self.only)
        if len(self) >= HELD:
            self.clear()
        self[token] = found
        return found

    def of(self, text: str | None) -> set[str]:
        out: set[str] = set()
        out.update(*map(self.__getitem__, set(WORD.findall(text or ""))))
        return out


def signs(text: str) -> tuple[int, int]:
    """How many characters are letters, and how many capitals."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.bincount(_kinds()[np.minimum(points, 0xFFFF)], minlength=3)
    return int(kinds[1] + kinds[2]), int(kinds[2])


@cache
def _kinds() -> np.ndarray:
    """Of the characters of the first plane: 2 for a capital, 1 for another letter."""
    return np.array([2 if c.isupper() and c.isalpha() else int(c.isalpha()) for c in map(chr, range(0x10000))], np.int64)


class Lexicon(dict):
    """Weights of words and beginnings; what a token is worth is remembered, nothing for most."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights
        self.firsts = {u[: STARTS[0]] for u in weights}

    def __missing__(self, token: str) -> tuple | None:
        """Weight, whether only a beginning counts, whether obfuscated, the word, whether it is a second person, whether all capitals."""
        word, hidden = read(token)
        weight, start = 0.0, False
        if word[: STARTS[0]] in self.firsts and len(word) <= LONGEST:
            weight = self.weights.get(word, 0.0)
            for k in STARTS:
                if k < len(word) and (w := self.weights.get(f"{word[:k]}-", 0.0)) > weight:
                    weight, start = w, True
        person, shouted = word in SECOND, len(token) > 1 and token.isupper()
        if len(self) >= HELD:
            self.clear()
        self[token] = out = (weight, start, hidden, word, person, shouted) if weight or hidden or person or shouted else None
        return out

    def __reduce__(self):
        return Lexicon, (self.weights,)

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        tokens = WORD.findall(text)
        n, size = max(1, len(tokens)), max(1, len(text))
        told = [(i, *x) for i, x in enumerate(map(self.__getitem__, tokens)) if x is not None]
        hits = [x for x in told if x[1]]
        persons = [x[0] for x in told if x[5]]
        weights = sorted((x[1] for x in hits), reverse=True)
        near, at = 0, 0
        for i, *_ in hits:
            while at < len(persons) and persons[at] < i - NEAR:
                at += 1
            near += at < len(persons) and persons[at] <= i + NEAR
        letters, capitals = signs(text)
        return [
            math.log1p(len(tokens)), len(hits) / n, sum(w >= STRONG for w in weights) / n, float(min(50, len({x[4] for x in hits if x[1] >= STRONG}))),
            weights[0] if weights else 0.0, weights[1] if len(weights) > 1 else 0.0, sum(weights) / len(weights) if weights else 0.0,
            sum(x[2] for x in hits) / n, near / n, len(persons) / n, capitals / max(1, letters), sum(x[6] for x in told) / n,
            sum(map(text.count, ".,;:!?")) / size, text.count("!") / size, sum(x[3] for x in told) / n, sum(x[3] for x in hits) / n,
        ]


def _counted(rows: DataFrame, only: frozenset[str] | None) -> DataFrame:
    """(unit, a, b): in how many of the texts ``t`` of each half ``h`` the units are, or those of ``only``."""
    shared = rows.sparkSession.sparkContext.broadcast(only)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> Iterator[pa.RecordBatch]:
            for some in batched(held[0].keys() | held[1].keys(), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *(pa.array([h[u] for u in some], pa.int64()) for h in held)], names=["unit", "a", "b"])
            held[0].clear()
            held[1].clear()

        units = Units(shared.value)
        for whole in batches:
            for batch in pieces(whole, 0):
                for text, half in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    held[half].update(units.of(text))
                    if len(held[0]) + len(held[1]) > HELD:
                        yield from out()
        yield from out()

    return in_arrow(rows.select("t", "h"), work, "unit string, a long, b long").groupBy("unit").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _weights(counts: list, toxic: int, others: int) -> dict[str, float]:
    """Of the candidates (unit, toxic documents, others) the entries and their weights."""
    least = max(LEAST, toxic / 400)
    rated = [(math.log((t + 0.5) / (toxic + 1)) - math.log((o + 0.5) / (others + 1)), t, u) for u, t, o in counts if t >= least]
    rated = sorted(((w, t, u) for w, t, u in rated if w >= WEIGHT), key=lambda x: (-x[0] * math.log1p(x[1]), x[2]))
    return {u: w for w, _, u in rated[:LEXICON]}


class Model:
    """The lexicons of the halves and of both, and the fitted trees and steps; without both labels, a constant."""

    def __init__(self, labelled: DataFrame, fit_rows: int = FIT_ROWS, trees: int = TREES):
        """``labelled`` has the text t, the label y and the remainder m, 1 to 4, of its rows."""
        self.trees = self.steps = None
        self.n_trees = trees
        half = (F.col("m") > 2).cast("int")
        rows = cut_table(labelled.select("t", F.col("y").cast("double").alias("y"), "m", half.alias("h")), "labelled")
        if (found := rows.count()) > 2 * fit_rows:  # documents of one id that come again and again
            rows = rows.sample(fit_rows / found, seed=1)
        sizes = {(r["h"], r["y"]): r["n"] for r in rows.groupBy("h", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
        n = lambda y: sizes.get((0, y), 0) + sizes.get((1, y), 0)
        self.constant = n(1.0) / max(1, n(0.0) + n(1.0))
        seen = _counted(rows.where("y = 1"), None).where(F.col("a") + F.col("b") >= LEAST)
        toxic = {r["unit"]: (r["a"], r["b"]) for r in seen.orderBy(F.desc(F.col("a") + F.col("b")), "unit").limit(CANDIDATES).toLocalIterator()}
        clean = {r["unit"]: (r["a"], r["b"]) for r in _counted(rows.where("y = 0"), frozenset(toxic)).toLocalIterator()} if toxic else {}
        both = [(u, a + b, sum(clean.get(u, (0, 0)))) for u, (a, b) in toxic.items()]
        self.lexicon = Lexicon(_weights(both, n(1.0), n(0.0)))
        self.halves = [Lexicon(_weights([(u, t[k], clean.get(u, (0, 0))[k]) for u, t in toxic.items()], sizes.get((k, 1.0), 0), sizes.get((k, 0.0), 0))) for k in (0, 1)]
        if n(0.0) and n(1.0):
            self._fit(rows)

    def _fit(self, rows: DataFrame) -> None:
        shared = rows.sparkSession.sparkContext.broadcast(self.halves)

        def other(values: list) -> list[list]:
            return [[shared.value[1 - v["h"]].features(v["t"]) for v in values]]

        given = rows.select("y", "m", F.struct("t", "h").alias("in"))
        table = cut_table(map_text(given, "in", [StructField("x", ArrayType(DoubleType(), False))], other, keep=False), "features").withColumn("features", array_to_vector("x"))
        apart = table.where("m <> 4"), table.where("m = 4")
        learn, check = apart if all(_both(t) for t in apart) else (table, table)
        self.trees = GBTClassifier(labelCol="y", maxIter=self.n_trees, maxDepth=DEPTH, stepSize=STEP, maxBins=64, minInstancesPerNode=3, seed=1).fit(learn)
        told = self.trees.transform(check).select("y", vector_to_array("rawPrediction")[1].alias("margin"))
        self.steps = IsotonicRegression(labelCol="y", featuresCol="margin").fit(told)

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``features`` in place of the text t, and ``score``."""
        shared = rows.sparkSession.sparkContext.broadcast(self.lexicon)
        made = map_text(rows, "t", [StructField("x", ArrayType(DoubleType(), False))], lambda values: [[shared.value.features(t) for t in values]], keep=False)
        if self.trees is None:
            return made.withColumn("score", F.lit(self.constant))
        told = self.trees.transform(made.withColumn("features", array_to_vector("x"))).withColumn("margin", vector_to_array("rawPrediction")[1])
        # Equal steps are told apart by the margin, which changes no verdict.
        near = self.steps.setPredictionCol("step").transform(told)
        score = F.col("step") + (1 / (1 + F.exp(-F.col("margin"))) - 0.5) * 1e-6
        return near.withColumn("score", F.when(F.col("step") >= 0.5, F.greatest(score, F.lit(0.5))).otherwise(F.least(score, F.lit(0.499999))).cast("double")).withColumn("score", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)))


def _both(table: DataFrame) -> bool:
    return table.select("y").distinct().count() == 2


def remainder(doc_id: Column) -> Column:
    """The CRC-32 of an id as text modulo 5; a null id has that of the empty text, 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS, trees: int = TREES) -> DataFrame:
    """``docs`` without its text, and held_out, score and predicted.

    ``labels`` is (doc_id, toxic); null ids and labels are left out, and of several of
    one document the largest counts.  Learned from are only labelled documents whose
    remainder isn't 0, about ``fit_rows`` of them by the hashes of their ids.  Without
    any, every score is 0, and with one label only, that label.  A null or empty text
    has no words and is scored like any other.  Rows are neither dropped nor merged; an
    empty table gives none.  Columns of the new names, whatever their case, are replaced.
    """
    named, (d, t) = placed(docs, doc_id, text)
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("of")).agg((F.max("toxic") > 0).cast("int").alias("y"))
    marks = marks.withColumn("m", remainder(F.col("of"))).where("m <> 0")
    if (n := marks.count()) > fit_rows:
        marks = marks.where(F.pmod(F.xxhash64("of"), F.lit(1 << 30)) < int((1 << 30) * fit_rows / n))
    met = named.select(d, F.col(t).alias("t")).join(F.broadcast(marks), F.col(d) == F.col("of"))
    model = Model(met.select("t", "y", "m"), fit_rows, trees)
    new = ["held_out", "score", "predicted"]
    kept = [i for i, c in enumerate(docs.columns) if without([c], [*new, text])]
    scored = model.score(named.select(*dict.fromkeys([*[f"c{i}" for i in kept], d]), F.col(t).alias("t")))
    out = scored.select(*[f"c{i}" for i in kept], (remainder(F.col(d)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
    return out.toDF(*[docs.columns[i] for i in kept], *new)


def op11(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return toxicity(docs.select("doc_id", "text"), labels)
