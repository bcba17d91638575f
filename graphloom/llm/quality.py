"""Quality rules: exact base rules, then an n-gram perplexity band for each language."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField

from ..plans.lineage import cut, cut_table
from .batches import map_text, placed, without
from .kneser_ney import slot, trained, units

WHITE = b" \t\n\x0b\x0c\r"
SIGNS = b"#*$%&|<>"
WINDOW = 8
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
NEW = [*BASE, "bits", "base_failed", "band_low", "band_high", "kept"]
#: Languages whose bands are broadcast; more are joined by a shuffle.
BANDS_SENT = 100_000
#: Keys of rejected texts that are broadcast, of about 40 bytes each; more are joined by a shuffle.
LOST_SENT = 300_000
#: Of the base verdict: words at least, and repeated words at most, in per cent.
LEAST, SHARE = 20, 30
#: Of the bands: quartile ranges on either side of the median, and the least quartile range in bits.
REACH, SPREAD = 3.0, 0.02


def base(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; zeros for a null or empty one."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: exactly at the six ASCII white-space characters
    chars = len(text) - (len(raw) - len(raw.translate(None, WHITE)))
    signs = len(raw) - len(raw.translate(None, SIGNS))
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    return len(words), chars, signs, len(lines) - len(set(lines)), repeated(words)


def repeated(words: list[bytes]) -> int:
    """Words inside windows of eight that the list holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n + k]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = True
    maybe[order[:-1][same]] = True
    seen: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(maybe).tolist():  # equal hashes: compare the words
        seen.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
    covered = np.zeros(len(words) + 1, np.int64)
    for places in seen.values():
        if len(places) > 1:
            at = np.array(places)
            np.add.at(covered, at, 1)
            np.add.at(covered, at + WINDOW, -1)
    return int((np.cumsum(covered) > 0).sum())


SCORES = [
    *(StructField(c, LongType(), False) for c in BASE),
    StructField("__n", LongType(), False),
    StructField("__hot", DoubleType(), False),
    StructField("__cold", ArrayType(LongType(), False), False),
]


def score(rows: DataFrame, text: str, lang: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` without the text as a written table, and the scores of its rows by ``__row``: base columns, base_failed, __slot and bits.

    Each text goes through Python once more after the model is counted.  What it
    finds by the broadcast model is summed there; its other grams are kept in the
    table and meet their costs in a join.
    """
    model, rest = trained(rows, text, lang)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    given = rows.withColumns({"__row": F.monotonically_increasing_id(), "__slot": slot(lang)})
    given = given.withColumn("__in", F.struct(F.col(text).alias("t"), F.col("__slot").alias("s"))).drop(text)

    def run(values: list) -> list[list]:
        texts = [v["t"] for v in values]
        slots = np.array([v["s"] for v in values], object)
        bits, cold = np.zeros(len(texts)), [None] * len(texts)
        for s in set(slots.tolist()):
            at = np.flatnonzero(slots == s).tolist()
            own, others = shared.value.cost([texts[i] for i in at], s)
            for i, b, c in zip(at, own.tolist(), others, strict=True):
                bits[i], cold[i] = b, c.view(np.int64)
        n = [len(units(t)) for t in texts]
        return [*map(list, zip(*map(base, texts), strict=True)), n, bits.tolist(), cold]

    table = cut_table(map_text(given, "__in", SCORES, run, keep=False), "scored")
    grams = table.select("__row", "__slot", F.explode("__cold").alias("__gram")).groupBy("__row", "__slot", "__gram").agg(F.count(F.lit(1)).alias("__times"))
    met = grams.join(rest, (F.col("__slot") == F.col("slot")) & (F.col("__gram") == F.col("gram")))
    sums = met.groupBy(F.col("__row").alias("__of")).agg(F.sum(F.col("__times") * F.col("bits")).alias("__more"))
    failed = (F.col("n_words") < LEAST) | (100 * F.col("n_repeat_words") > SHARE * F.col("n_words"))
    bits = F.when(F.col("__n") > 0, (F.col("__hot") + F.coalesce("__more", F.lit(0.0))) / F.col("__n")).otherwise(0.0)
    narrow = table.select("__row", "__slot", "__n", "__hot", *BASE).join(sums, F.col("__row") == F.col("__of"), "left")
    return table.drop("__slot", "__n", "__hot", "__cold", *BASE), narrow.select("__row", "__slot", *BASE, failed.alias("base_failed"), bits.alias("bits"))


def judge(scores: DataFrame, reach: float, spread: float) -> DataFrame:
    """``scores`` with band_low, band_high and kept in place of __slot, by the bands of their languages.

    A language whose documents all fail the base rules has null bands, and so has
    none that is kept.
    """
    own = cut_table(scores, "scores")
    q = F.percentile_approx(F.when(~F.col("base_failed"), F.col("bits")), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(10000))
    bands = own.groupBy(F.col("__slot").alias("__of")).agg(q.alias("__q"))
    bands = F.broadcast(bands) if own.select("__slot").distinct().count() <= BANDS_SENT else bands
    half = reach * F.greatest(F.lit(spread), F.col("__q")[2] - F.col("__q")[0]) * (1 + 10 / F.sqrt(F.greatest("word_chars", F.lit(1))))
    judged = own.join(bands, F.col("__slot") == F.col("__of"))
    judged = judged.withColumn("band_low", F.col("__q")[1] - half).withColumn("band_high", F.col("__q")[1] + half)
    inside = F.coalesce(F.col("bits").between(F.col("band_low"), F.col("band_high")), F.lit(True))
    return judged.withColumn("kept", ~F.col("base_failed") & inside).drop("__slot", "__of", "__q")


def quality(docs: DataFrame, text: str = "text", lang: str = "lang", reach: float = REACH, spread: float = SPREAD) -> DataFrame:
    """``docs`` without its text, and the base columns, base_failed, bits (mean cost of a character), band_low, band_high and kept.

    The model is trained on all documents.  A language's band is its median cost
    plus and minus ``reach`` times its quartile range, which counts as ``spread``
    bits at least and is widened for short texts, whose mean cost varies more.  A
    null or empty text has no words and fails; a null language is one of its own.
    Rows are neither dropped nor merged, repeated ones count as often as they come;
    an empty table gives none.  Columns of the new names, whatever their case, are
    replaced.
    """
    kept = [i for i, c in enumerate(docs.columns) if c in without([c], [*NEW, text])]
    named, (t, g) = placed(docs, text, lang)
    table, scores = score(named, t, g)
    out = table.join(judge(scores, reach, spread), "__row").select(*[f"c{i}" for i in kept], *NEW)
    return out.toDF(*[docs.columns[i] for i in kept], *NEW)


def op3(docs: DataFrame) -> DataFrame:
    """doc_id, the five base columns, base_failed, kept, and the cost and band behind the verdict."""
    return quality(docs.select("doc_id", "lang", "text")).select("doc_id", *BASE, "base_failed", "kept", "bits", "band_low", "band_high")


def passing(docs: DataFrame, text: str = "text", lang: str = "lang", reach: float = REACH, spread: float = SPREAD) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all of their columns and in repeats as they come.

    A verdict depends on the text and its language, so the rejected ones are taken
    out by two hashes of the text and its language, and no text is written.
    """
    named, (t, g) = placed(docs, text, lang)
    own = F.coalesce(F.col(t), F.lit(""))
    keyed = named.withColumns({"k1": F.xxhash64(own), "k2": F.xxhash64(F.lit(1), own), "k3": slot(g)})
    table, scores = score(keyed.select("k1", "k2", "k3", t, g), t, g)
    lost = cut(table.join(judge(scores, reach, spread).where(~F.col("kept")).select("__row"), "__row").select("k1", "k2", "k3").distinct())
    lost = F.broadcast(lost) if lost.count() <= LOST_SENT else lost
    return keyed.join(lost, ["k1", "k2", "k3"], "left_anti").select(*named.columns).toDF(*docs.columns)
