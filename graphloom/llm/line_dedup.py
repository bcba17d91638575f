"""Line deduplication by a log-template tree, in DataFrame expressions only.

A line goes down a tree of fixed depth: by its number of tokens, then by its
leading tokens, where a token with a digit counts as a variable field.  In a leaf
with several different lines the frequency of each token at each place is counted
over these.  A token of a line is constant there if another line shares it and it
is at least half as frequent as the line's middle token; the others are variable
fields.  A template is what is constant, by place.  At most a quarter of a line's
tokens may be variable words and at most half of them fields of any kind;
otherwise the line is a template of its own.

A template recurs if two documents hold it.  Of the lines of a recurring template,
those of the document with the smallest id stay and the others go, so no content
is lost with all of its copies.

Equal lines are counted once: only hashes of lines are shuffled, the tokens of the
few lines that share a leaf, and the texts once, to meet their drops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut_table
from .batches import placed, without

#: Leading tokens of a leaf.
DEPTH = 2
FIELD = "<*>"
#: Lines of a leaf for each salt of the join with its frequencies.
SALTED = 100_000
NEW = ["n_lines", "n_dropped"]


def _tokens(line: Column) -> Column:
    return F.array_remove(F.split(F.translate(line, "\t\x0b\x0c\r", "    "), " "), "")


def _masked(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit(FIELD)).otherwise(token)


def _lines(docs: DataFrame, text: str, doc_id: str, once: bool) -> DataFrame:
    """(doc_id, raw): the lines of each text, with ``once`` those of a text that are equal once."""
    lines = F.split(text, "\n")
    return docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.explode(F.array_distinct(lines) if once else lines).alias("raw"))


def leaves(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, line, leaf): of each line with a word, a hash of it and of its leaf."""
    parsed = _lines(docs, text, doc_id, False).select("doc_id", F.xxhash64("raw").alias("line"), _tokens(F.col("raw")).alias("t")).where(F.size("t") > 0)
    return parsed.select("doc_id", "line", F.xxhash64(F.size("t"), *[_masked(F.get("t", F.lit(i))) for i in range(DEPTH)]).alias("leaf"))


def shapes(docs: DataFrame, shared: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(line, template): of the lines of ``shared`` (line, leaf, lines, first) that have one.

    ``lines`` is the number of different lines in the leaf, and ``first`` a document
    with the line.
    """
    raw = _lines(docs, text, doc_id, True).withColumn("hash", F.xxhash64("raw"))
    own = raw.join(shared, (F.col("hash") == F.col("line")) & (F.col("doc_id") == F.col("first"))).select("line", "leaf", "lines", F.transform(_tokens(F.col("raw")), _masked).alias("t"))
    own = cut_table(own.dropDuplicates(["line"]), "tokens")
    at = own.select("line", "leaf", "lines", F.posexplode(F.slice("t", DEPTH + 1, F.greatest(F.size("t"), F.lit(1)))).alias("place", "word")).where(F.col("word") != FIELD).select("line", "leaf", "lines", "place", F.xxhash64("word").alias("word"))
    salts = (F.col("lines") / SALTED).cast("int")
    often = at.groupBy("leaf", "lines", "place", "word").agg(F.count(F.lit(1)).alias("c")).where("c > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), salts))).drop("lines")
    salted = at.withColumn("salt", F.pmod("line", salts + 1).cast("int"))
    met = salted.join(often, ["leaf", "place", "word", "salt"], "left")
    met = met.withColumn("c", F.coalesce("c", F.lit(1)))
    by = met.groupBy("line").agg(F.collect_list(F.struct("c", "place", "word")).alias("w"), F.expr("percentile_disc(0.5) within group (order by c)").alias("m"))
    known = own.join(by.withColumnRenamed("line", "of"), F.col("line") == F.col("of"), "left").withColumn("w", F.coalesce("w", F.array().cast("array<struct<c:bigint,place:int,word:bigint>>")))
    known = known.withColumn("kept", F.expr("filter(w, x -> x.c > 1 and 2 * x.c >= m)"))
    words, fields = F.size("w") - F.size("kept"), F.size(F.filter("t", lambda x: x == FIELD))
    fits = (4 * words <= F.size("t")) & (2 * (words + fields) <= F.size("t"))
    constant = F.array_sort(F.transform("kept", lambda x: F.struct(x["place"].alias("place"), x["word"].alias("word"))))
    return known.where(fits).select("line", F.xxhash64("leaf", constant).alias("template"))


def recurring(docs: DataFrame, found: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(line, first): the lines whose template several documents hold, and the smallest of these."""
    distinct = cut_table(found.groupBy("line", "leaf").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "distinct")
    full = distinct.groupBy("leaf").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1")
    shared = cut_table(distinct.join(full, "leaf").select("line", "leaf", "lines", "first", "last"), "shared")
    told = cut_table(shapes(docs, shared.drop("last"), text, doc_id).withColumnRenamed("line", "of"), "templates")
    known = shared.join(told, F.col("line") == F.col("of")).select("line", "first", "last", "template")
    several = known.groupBy("template").agg(F.min("first").alias("smallest"), F.max("last").alias("largest")).where("smallest < largest")
    general = known.join(several, "template").select("line", F.col("smallest").alias("first"))
    # A line that is a template of its own recurs if it has two documents itself; most have one and go no further.
    alone = distinct.where("first < last").join(told, F.col("line") == F.col("of"), "left_anti").select("line", "first")
    return general.unionAll(alone)


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with the lines of recurring templates taken out of ``text``, and n_lines and n_dropped.

    A line that repeats within one document only stays, as do lines without a
    word and the rows without an id.  A null text stays null and has no lines; an
    empty one has one.  Rows are neither dropped nor merged: repeated rows with one
    id are one document and are treated alike.  A text whose lines all go is empty,
    and an empty table gives none.  Columns of the new names, whatever their case,
    are replaced.
    """
    own, names = placed(docs, text, doc_id)
    kept = [i for i, c in enumerate(docs.columns) if without([c], NEW)]
    return _dropped(own, *names).select(*[f"c{i}" for i in kept], *NEW).toDF(*[docs.columns[i] for i in kept], *NEW)


def without_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Like ``dedup_lines``, with the columns of ``docs`` as they are and no others."""
    own, names = placed(docs, text, doc_id)
    return _dropped(own, *names).select(*own.columns).toDF(*docs.columns)


def _dropped(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    found = cut_table(leaves(docs, text, doc_id), "lines")
    marks = recurring(docs, found, text, doc_id).withColumnRenamed("line", "of")
    gone = found.join(marks, (F.col("line") == F.col("of")) & (F.col("doc_id") > F.col("first"))).groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_set("line").alias("__gone"))
    joined = docs.join(gone, F.col(doc_id) == F.col("__doc"), "left")
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains("__gone", F.xxhash64(x)))
    n = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long")
    return (
        joined.withColumn("__kept", F.when(F.col("__gone").isNotNull(), kept))
        .withColumns({"n_lines": n, "n_dropped": F.coalesce(n - F.size("__kept"), F.lit(0)).cast("long")})
        .withColumn(text, F.when(F.col("__kept").isNotNull(), F.array_join("__kept", "\n")).otherwise(F.col(text)))
        .drop("__doc", "__gone", "__kept")
    )


def op10(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, text."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", *NEW, "text")
