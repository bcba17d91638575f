"""Personal data: exact base patterns, then bootstrapped contextual extraction.

The base matches are the seeds.  Candidates are all maximal spans of identifier
tokens, those with a digit or an @, of any length and with the spaces, colons and
brackets between them, that no base match touches.  Each mention of a seed or
candidate has lexical patterns: the words around it, and the label that is written
to it with a colon or an equals sign.  The patterns and the instances they surround
form a bipartite graph, which Spark scores in rounds: a pattern is as reliable, for
a kind, as the instances that it surrounds, and an instance is as likely of that
kind as its reliable patterns say together.  Rounds go on until no new pattern
passes a high confidence, with enough different instances behind it.  Those that
passed mark the identifiers that no base pattern matches.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..plans.lineage import cut, cut_table
from .batches import map_text, placed, without

KINDS = ["email", "ip", "card", "phone"]
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # from the start of a run of digits, where every match starts
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SIGN = re.compile(r"[0-9@]")
EDGES = ".,;:!?\"'()[]{}<>"
#: A word that labels what follows it in the same token.
LABEL = re.compile(r"[^0-9@=:]*[A-Za-z][^0-9@=:]*[=:]+(?=.)|[^=]*[A-Za-z][^=]*=(?=.)")
#: What may stand between two tokens of one identifier.
JOINT = re.compile(r"[\x20\x09]+")
#: Of the bootstrapping: confidence and different instances of a pattern at least.
CONFIDENCE, SUPPORT = 0.8, 3.0


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the base pattern; from each @ back over its local part, so long runs are read once."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)
    return out


def base(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed and then by start."""
    if not text or not SIGN.search(text):
        return []
    out = [("email", a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def _word(token: str) -> str:
    return token.strip(EDGES).lower()


def patterns(text: str, words: list[tuple[int, int]], starts: list[int], start: int, end: int) -> list[str]:
    """The words before and after a mention, alone and together; a label in its own token counts as the word before.

    ``words`` are the places of all tokens of the text, and ``starts`` their starts.
    """
    first = max(0, bisect_right(starts, start) - 1)
    last = max(0, bisect_right(starts, end - 1) - 1)
    own = text[words[first][0] : start].lstrip(EDGES).lower()
    before = [_word(text[a:b]) for a, b in words[max(0, first - 2) : first]]
    left = [*before, own][-2:] if own else before[-2:]
    rest = _word(text[end : words[last][1]])
    right = rest or (_word(text[slice(*words[last + 1])]) if last + 1 < len(words) else "")
    out = []
    if left and left[-1]:
        out.append(f"{left[-1]} _")
        if len(left) > 1 and left[0]:
            out.append(f"{left[0]} {left[-1]} _")
        if right:
            out.append(f"{left[-1]} _ {right}")
    if right:
        out.append(f"_ {right}")
    return out


def candidates(text: str, words: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal spans of identifier tokens that touch no span of ``taken``, which is sorted."""
    out: list[tuple[int, int]] = []
    open_at = -1  # where the last token ended, if the span can go on
    k = 0
    for a, b in words:
        if not SIGN.search(text, a, b):
            open_at = -1
            continue
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k < len(taken) and taken[k][0] < b:
            open_at = -1
            continue
        whole = a
        if m := LABEL.match(text, a, b):
            a = m.end()
        while a < b and text[a] in EDGES and text[a] != "(":
            a += 1
        end = b
        while end > a and text[end - 1] in EDGES and text[end - 1] != ")":
            end -= 1
        if a >= end or not SIGN.search(text, a, end):
            open_at = -1
            continue
        if out and open_at >= 0 and a == whole and JOINT.fullmatch(text, open_at, a):
            out[-1] = (out[-1][0], end)
        else:
            out.append((a, end))
        open_at = end if end == b else -1
    return out


def mentions(text: str | None) -> list[dict]:
    """Base matches and candidates, with surface and patterns; none for a null text."""
    if not text or not SIGN.search(text):
        return []
    found = base(text)
    words = [m.span() for m in WORD.finditer(text)]
    starts = [a for a, _ in words]
    every = found + [(None, a, b) for a, b in candidates(text, words, sorted((a, b) for _, a, b in found))]
    return [{"kind": kind, "start": a, "end": b, "surface": text[a:b].lower(), "patterns": patterns(text, words, starts, a, b)} for kind, a, b in every]


MENTION = StructType([StructField("kind", StringType()), StructField("start", IntegerType(), False), StructField("end", IntegerType(), False), StructField("surface", StringType(), False), StructField("patterns", ArrayType(StringType(), False), False)])


def reliable(found: DataFrame, confidence: float = CONFIDENCE, support: float = SUPPORT, rounds: int = 100) -> DataFrame:
    """(pattern, kind, conf) of the patterns to trust; ``found`` has kind, surface and patterns of each mention.

    Every round is one join of the graph with the instances' scores and one with
    the patterns' reliabilities, both keyed tables, and its result is written.
    Scores never fall, so a pattern that has passed stays; the rounds end when none
    is new.  Instances count once for each pattern, however often they repeat.
    """
    graph = cut_table(found.select("surface", F.explode("patterns").alias("pattern")).distinct(), "graph")
    seeds = cut(found.where("kind is not null").select("surface", "kind").distinct().withColumn("score", F.lit(1.0)))
    size = cut(graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support))
    scores, passed = seeds, -1
    for _ in range(rounds):
        held = graph.join(scores, "surface").groupBy("pattern", "kind").agg(F.sum("score").alias("support")).where(F.col("support") >= support)
        conf = F.col("support") / F.col("n")
        kept = cut(held.join(size, "pattern").select("pattern", "kind", conf.alias("conf")).where(F.col("conf") >= confidence))
        n = kept.count()
        if n in (0, passed):
            return kept
        passed = n
        none = F.exp(F.sum(F.log(1 - F.least("conf", F.lit(0.999)))))
        more = graph.join(kept, "pattern").groupBy("surface", "kind").agg((1 - none).alias("score"))
        scores = cut(seeds.unionAll(more).groupBy("surface", "kind").agg(F.max("score").alias("score")))
    raise RuntimeError(f"patterns are still new after {rounds} rounds")


def extract(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, and base and found: arrays of (kind, start, end), in code points.

    ``base`` has the exact matches by kind as listed and then by start; ``found``
    the identifiers that reliable patterns mark, with the kind of the most
    confident one (ties: the smaller name).  A null or empty text has neither.
    Rows are neither dropped nor merged, repeated ones count once as instances; an
    empty table gives none.  Columns of the new names, whatever their case, are
    replaced.
    """
    kept = [i for i, c in enumerate(docs.columns) if without([c], ["base", "found", text])]
    own, (t,) = placed(docs, text)
    own = own.select(*[f"c{i}" for i in kept], F.col(t).alias("__text"))
    read = map_text(own, "__text", [StructField("__m", ArrayType(MENTION, False), False)], lambda texts: [[mentions(x) for x in texts]], keep=False)
    rows = cut_table(read.withColumn("__row", F.monotonically_increasing_id()), "mentions")
    found = rows.where(F.size("__m") > 0).select("__row", F.explode("__m").alias("m")).select("__row", "m.*")
    trusted = reliable(found)
    unseen = found.where("kind is null").select("__row", "start", "end", F.explode("patterns").alias("pattern"))
    best = unseen.join(trusted, "pattern").groupBy("__row", "start", "end").agg(F.min(F.struct((-F.col("conf")).alias("c"), "kind"))["kind"].alias("kind"))
    by = best.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("found_"), "kind").alias("kind"), "start", "end"))).alias("found"))
    base_spans = F.transform(F.filter("__m", lambda m: m["kind"].isNotNull()), lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    out = rows.join(by, "__row", "left").withColumn("base", base_spans)
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    out = out.withColumn("found", F.coalesce("found", none)).select(*[f"c{i}" for i in kept], "base", "found")
    return out.toDF(*[docs.columns[i] for i in kept], "base", "found")


def op8(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = extract(docs.select("doc_id", "text"))
    shown = lambda c: F.transform(c, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string")))
    count = lambda k: F.size(F.filter("base", lambda m: m["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(F.concat_ws(",", shown("base")), 256).alias("base_sha256"),
        F.concat_ws(",", F.concat(shown("base"), shown("found"))).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every base match replaced by its kind in angle brackets; overlapping ones as one, named by the first; a null text stays null."""

    def run(texts: list) -> list[list]:
        out = []
        for t in texts:
            at, parts = 0, []
            for kind, a, b in sorted(base(t), key=lambda s: (s[1], s[2])):
                if a >= at:
                    parts += [t[at:a], f"<{kind}>"]
                at = max(at, b)
            out.append(None if t is None else "".join(parts) + t[at:])
        return [out]

    own, (t,) = placed(docs, text)
    clean = map_text(own, t, [StructField("__clean", StringType())], run).withColumn(t, F.col("__clean")).drop("__clean")
    return clean.toDF(*docs.columns)
