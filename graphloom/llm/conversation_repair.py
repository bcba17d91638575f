"""The cheapest repair of the turns of conversations, by a recursive DuckDB query inside hash-partitioned batches.

A repaired conversation is ``(s?(ua)+)?`` in the initials of its roles.  The grammar
has four states: nothing yet, after a system, a user and an assistant turn.  A turn's
edits, with what is inserted before it, are a table of (from, to, cost, letters), one
for each of the nine kinds of turns; the query advances every conversation of a batch
by one turn in each recursion and keeps, for each pair of states, the least cost and
of equal costs the least audit.  That is exact: a letter's cost depends on its turn
alone, so of two audits of one cost none begins with the other.

No conversation is held whole.  Turns are range-sorted by conversation and turn, and
64 neighbouring places make a segment, so a long conversation is many segments in many
tasks.  A segment's result is itself a table of (from, to, cost, letters), and 64 of
them are advanced by the same query again, until each conversation has one.  The text
is hashed in a last pass over the turns in their order, one at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..plans.lineage import cut, cut_table
from .batches import in_arrow

WHITE = r"\x20\x09-\x0D"
#: Places that make a segment, and segments that are joined at a time; a power of two.
TOGETHER = 64
#: Segments that a query takes at a time.
BATCH = 500
START, SYSTEM, USER, ASSISTANT = range(4)
#: Which turn may follow in each state, and the state after it.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: States at which a conversation may end, after these insertions.
ENDS = {START: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}
#: Costs: of a changed role, of a deletion, of an insertion and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Kinds of turns: the place of the initial here, 4 more if truncated; GONE must be deleted.
INITIALS, GONE = "sua", 8
ROLES = {"u": "user", "a": "assistant"}


def edits() -> list[tuple[int, int, int, int, str]]:
    """(kind, from, to, cost, letters) of all ways to treat a turn, with the insertions before it."""
    out = []
    for start in range(4):
        reach, state = [(start, "")], start
        for n in (1, 2):
            state = NEXT[(state, "u")] if (state, "u") in NEXT else NEXT[(state, "a")]
            reach.append((state, "I" * n))
        for at, before in reach:
            paid = INSERT * len(before)
            for kind in range(GONE + 1):
                out.append((kind, start, at, paid + DELETE, before + "D"))
                if kind == GONE:
                    continue
                stays = paid + (TRUNCATED if kind >= 4 else 0)
                own = INITIALS[kind % 4 : kind % 4 + 1]
                for x in INITIALS:
                    if (to := NEXT.get((at, x))) is not None and (x == own or x != "s"):
                        out.append((kind, start, to, stays + (0 if x == own else REROLE), before + ("K" if x == own else "R")))
    return out


ADVANCE = """with recursive w(k, i, p, q, cost, audit) using key (k, p, q) as (
  select k, 0, s, s, 0::bigint, '' from sizes, (values (0), (1), (2), (3)) t(s)
  union all
  select k, i + 1, p, q, b.cost, b.audit from (
    select w.k, w.i, w.p, t.q, min({'cost': w.cost + t.cost, 'audit': w.audit || t.letters}) as b
    from w join items t on t.k = w.k and t.i = w.i and t.p = w.q group by w.k, w.i, w.p, t.q))
select w.k, p, q, cost, audit from w join sizes on sizes.k = w.k and w.i = sizes.n"""

EDGES = "array<struct<p:int,q:int,cost:bigint,letters:string>>"


def _advanced(df: DataFrame, column: str, items: str, new: StructField) -> DataFrame:
    """``df`` with the edges from state to state that the items of each row's ``column`` make up, in place of that column.

    ``items`` is the query that gives (k, i, p, q, cost, letters) of the rows ``given``
    (k, x); no row has more than TOGETHER items.
    """
    at = df.columns.index(column)
    schema = StructType([*(f for f in df.schema if f.name != column), new])
    ways = edits()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        own = duckdb.connect(config={"threads": 1})
        own.register("ways", pa.table(dict(zip(("kind", "p", "q", "cost", "letters"), map(pa.array, zip(*ways, strict=True)), strict=True))))
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                own.register("given", pa.table({"k": pa.array(range(batch.num_rows), pa.int64()), "x": batch.column(at)}))
                own.execute("create or replace temp table sizes as select k, len(x) as n from given")
                own.execute(f"create or replace temp table items as {items}")
                found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
                for k, p, q, cost, audit in own.execute(ADVANCE).fetchall():
                    found[k].append({"p": p, "q": q, "cost": cost, "letters": audit})
                own.unregister("given")
                kept = [batch.column(i) for i in range(batch.num_columns) if i != at]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(found, EDGE_TYPE)], names=schema.names)
        own.close()

    return in_arrow(df, work, schema)


EDGE_TYPE = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("letters", pa.string())]))
OF_TURNS = "select g.k, g.i - 1 as i, ways.p, ways.q, ways.cost, ways.letters from (select k, unnest(x) as kind, generate_subscripts(x, 1) as i from given) g join ways on ways.kind = g.kind"
OF_SEGMENTS = "select h.k, h.i - 1 as i, e.p, e.q, e.cost, e.letters from (select g.k, g.i, unnest(g.s) as e from (select k, unnest(x) as s, generate_subscripts(x, 1) as i from given) g) h"


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, turn, role, text) after the damage that the CRC-32 of ``conv:turn`` modulo 20 tells; nulls count as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    n = F.crc32(F.concat(text("conv"), F.lit(":"), text("turn"))) % 20
    role, said = text("role"), text("text")
    hurt = rows.select(
        "conv", "turn", F.when(n == 4, "user").otherwise(role).alias("role"),
        F.when(n == 1, "").when(n == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said).alias("text"), n.alias("n"),
    ).where("n <> 0")
    return hurt.withColumn("n", F.explode(F.when(F.col("n") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("n")


def in_order(rows: DataFrame) -> DataFrame:
    """``rows`` with ``pos``, which grows along the turns of each conversation; a written table.

    Nulls come first; turns of one number are in the order of role and text, and rows
    that are equal in all of these can't be told apart.
    """
    dealt = rows.repartitionByRange("conv", "turn", "role", "text").sortWithinPartitions("conv", "turn", "role", "text")
    return cut_table(dealt.withColumn("pos", F.monotonically_increasing_id()), "turns")


def same(a: DataFrame, b: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """The join on equal keys, nulls together, with ``a``'s keys only."""
    named = b.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return a.join(named, on, how).drop(*[f"__{k}" for k in keys])


def _segments(turns: DataFrame) -> DataFrame:
    """A row for each segment: its kinds of turns in order, counts of faults and illegal neighbours, first and last initial.

    The number of a segment, ``idx``, counts from 0 in each conversation.
    """
    narrow = turns.select(
        "conv", "pos", F.substring("role", 1, 1).alias("initial"), F.col("role").alias("r"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"),
        (~F.col("text").rlike(f"[^{WHITE}]")).alias("blank"), (~F.col("text").rlike(rf"[.!?][{WHITE}]*\z")).alias("open"),
    )
    seen = narrow.groupBy("conv", "r", "h1", "h2").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    met = same(narrow, seen, "conv", "r", "h1", "h2", how="left")
    again = F.coalesce(F.col("pos") > F.col("first"), F.lit(False))
    letter = F.when(F.col("initial") == "", 4).otherwise(F.instr(F.lit(INITIALS), F.col("initial")))  # 1 to 3, 0 for others
    base = F.when(letter.between(1, 3), letter - 1).otherwise(3)
    kind = F.when(F.col("blank") | again, GONE).otherwise(base + F.when(F.col("open"), 4).otherwise(0))
    marked = met.select("conv", F.shiftright("pos", 6).alias("seg"), "pos", "initial", kind.cast("int").alias("kind"), F.col("blank").cast("long").alias("blank"), (~F.col("blank") & again).cast("long").alias("duplicate"), (~F.col("blank") & ~again & F.col("open")).cast("long").alias("truncated"))
    sums = marked.groupBy("conv", "seg").agg(F.array_sort(F.collect_list(F.struct("pos", "initial", "kind"))).alias("own"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    pairs = F.zip_with(F.slice("own", 1, F.size("own") - 1), F.slice("own", 2, F.size("own") - 1), lambda a, b: F.concat(a["initial"], b["initial"]))
    wrong = lambda pair: ~pair.isin("su", "ua", "au")
    inner = F.size(F.filter(pairs, wrong)).cast("long")
    whole = cut(sums.select("conv", "seg", F.col("own.kind").alias("kinds"), F.col("own")[0]["pos"].alias("pos"), F.col("own")[0]["initial"].alias("first"), F.element_at("own", -1)["initial"].alias("last"), inner.alias("inner"), "blank", "duplicate", "truncated"))
    part = F.shiftright("pos", 33)  # the task that wrote the row; the segments of a conversation are consecutive in each
    runs = whole.groupBy("conv", part.alias("part")).agg(F.min("seg").alias("low"), F.max("seg").alias("high"))
    before = F.sum(F.col("high") - F.col("low") + 1).over(_before("conv", "part"))
    runs = runs.select("conv", "part", (F.coalesce(before, F.lit(0)) - F.col("low")).alias("shift"))
    numbered = cut(same(whole.withColumn("part", part), runs, "conv", "part").select("*", (F.col("seg") + F.col("shift")).alias("idx")).drop("part", "shift", "seg"))
    left = numbered.select("conv", (F.col("idx") + 1).alias("idx"), F.col("last").alias("previous"))
    met = same(numbered, left, "conv", "idx", how="left")
    between = F.when(F.col("previous").isNotNull() & wrong(F.concat("previous", "first")), 1).otherwise(0)
    return met.withColumn("illegal", F.col("inner") + between).drop("inner", "first", "last", "previous")


def _before(by: str, order: str):
    from pyspark.sql.window import Window

    return Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def cheapest(segments: DataFrame) -> DataFrame:
    """(conv, cost, audit) of the segments (conv, idx, kinds)."""
    field = StructField("edges", _edge_type())
    now = cut_table(_advanced(segments.select("conv", "idx", "kinds").repartition("conv", "idx"), "kinds", OF_TURNS, field), "edges")
    while now.select(F.max("idx")).first()[0]:
        several = now.groupBy("conv", F.floor(F.col("idx") / TOGETHER).alias("idx")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("i"), "edges"))), lambda x: x["edges"]).alias("all"))
        now = cut_table(_advanced(several, "all", OF_SEGMENTS, field), "edges")
    ends = F.filter("edges", lambda e: e["p"] == START)
    closed = F.transform(ends, lambda e: F.struct((e["cost"] + INSERT * _after(e["q"])).alias("cost"), F.concat(e["letters"], F.repeat(F.lit("I"), _after(e["q"]))).alias("audit")))
    return now.select("conv", F.array_min(closed).alias("best")).select("conv", "best.*")


def _after(state: Column) -> Column:
    return F.when(state == USER, ENDS[USER]).when(state == SYSTEM, ENDS[SYSTEM]).otherwise(0)


def _edge_type():
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(EDGES)


def _hashed(turns: DataFrame, segments: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, sha) of the repaired text: the turns pass by in order, before each segment's its share of the audit."""
    shape = segments.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("idx", "pos", F.size("kinds").alias("n")))).alias("own"))
    conv = turns.schema["conv"]
    shares = StructType([conv, StructField("pos", LongType()), StructField("letters", StringType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                own, audit = batch.column(1)[r].as_py(), batch.column(2)[r].as_py()
                tail = audit[len(audit.rstrip("I")) :]
                odd = "s" if len(audit.replace("D", "")) % 2 else "-"  # only a system turn makes the number of turns odd
                each, at, out = re.findall("I*[DKR]", audit), 0, []
                for x in own:
                    out.append(f"{odd}{tail} {' '.join(each[at : at + x['n']])}")
                    at += x["n"]
                for k in range(0, len(out), 10_000):
                    part = slice(k, k + 10_000)
                    n = len(out[part])
                    same = pa.concat_arrays([batch.column(0).slice(r, 1)] * n)
                    yield pa.RecordBatch.from_arrays([same, pa.array([x["pos"] for x in own[part]], pa.int64()), pa.array(out[part], pa.string())], names=shares.names)

    dealt = in_arrow(same(shape, found, "conv").select("conv", "own", "audit"), deal, shares)
    both = dealt.select("conv", "pos", F.lit(0).alias("row"), "letters", F.lit("").alias("role")).unionAll(turns.select("conv", "pos", F.lit(1), "text", "role"))
    ordered = both.repartition("conv").sortWithinPartitions("conv", "pos", "row")
    schema = StructType([conv, StructField("sha", StringType())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([current.conv, pa.array([current.end()], pa.string())], names=schema.names)

        for batch in batches:
            convs = batch.column(0)
            rows = zip(convs.to_pylist(), *(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)
            for i, (conv, row, text, role) in enumerate(rows):
                if current is None or current.key != conv:
                    if current is not None:
                        yield done()
                    current = Repaired(conv, pa.concat_arrays([convs.slice(i, 1)]))
                if row:
                    current.turn(role, text)
                else:
                    current.share(text)
        if current is not None:
            yield done()

    return in_arrow(ordered, digest, schema)


class Repaired:
    """The digest of one conversation's repaired text, turn by turn."""

    def __init__(self, key, conv: pa.Array):
        self.key, self.conv, self.hash, self.n = key, conv, hashlib.sha256(), 0
        self.system, self.tail, self.letters = False, "", iter(())

    def share(self, said: str) -> None:
        """What happens to the turns of the next segment."""
        head, _, letters = said.partition(" ")
        self.system, self.tail, self.letters = head[0] == "s", head[1:], iter(letters.split(" "))

    def add(self, role: str | None, text: str) -> None:
        if role is None:
            role = ROLES["ua"[(self.n + self.system) % 2]]
        self.hash.update(f"{chr(10) if self.n else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.n += 1

    def turn(self, role: str, text: str) -> None:
        what = next(self.letters)
        for _ in what[:-1]:
            self.add(None, "")
        if what[-1] != "D":
            self.add(role if what[-1] == "K" else None, text)

    def end(self) -> str:
        for _ in self.tail:
            self.add(None, "")
        return self.hash.hexdigest()


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair(rows: DataFrame, turns: DataFrame, conv: str = "conv") -> DataFrame:
    """For each conversation of ``rows``: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of its ``turns``.

    ``turns`` is (conv, turn, role, text), without null roles or texts; its null
    conversations are one.  A conversation without turns has zeros, an empty audit and
    the hash of the empty string.  Roles are told by their first letter; others than
    s, u and a have no place in the grammar, nor has an empty role.  Repeated rows are
    repeated turns, all but the first duplicates.  An empty table gives none.
    """
    placed = in_order(turns)
    segments = cut(_segments(placed))
    found = cut_table(cheapest(segments), "audits")
    spans = placed.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    faults = segments.groupBy("conv").agg(*[F.sum(c).alias(c) for c in COUNTS[1:5]])
    out = rows.select("conv").distinct()
    for part in (spans, faults, found, _hashed(placed, segments, found)):
        out = same(out, part, "conv", how="left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS]
    return out.select("conv", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op13(conversations: DataFrame) -> DataFrame:
    """conv_id and what ``repair`` tells of every original conversation after the damage."""
    rows = conversations.select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    return repair(rows, damaged(rows)).withColumnRenamed("conv", "conv_id")
