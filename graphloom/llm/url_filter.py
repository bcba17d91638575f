"""URL filters: host and path rules, and a Bloom filter cascade for listed domains.

The cascade's first level encodes the listed keys.  Over the complete universe of
keys (every host of the corpus and every parent domain of one) its false
positives are known, so the second level encodes those; the third encodes the
listed keys that pass the second by mistake, and so on until no level errs.  A
key of the universe is listed exactly if the first level that lacks it is an
even one, or there is none and the number of levels is odd.  Lookups are hash and
bit operations on literals: no join and no Python.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .bitmaps import bitmap

#: Bits for each key of the first level and of the later ones, and hash values for each key.
FIRST, LATER = (12, 8), (4, 3)
#: Bytes that all levels may take as literals in a plan, about 12 bits for each listed key: 80 million keys of the
#: corpus.  A longer list is joined instead, since no task could hold its cascade.
LITERAL_BYTES = 128_000_000


@dataclass
class Level:
    bits: bytes
    size: int
    hashes: int
    seed: int

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed), F.lit(j)), F.lit(self.size)) for j in range(self.hashes)]

    def has(self, key: Column) -> Column:
        store, out = F.lit(self.bits), None
        for at in self.positions(key):
            byte = F.conv(F.hex(F.substring(store, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            bit = F.pmod(F.floor(byte / F.pow(F.lit(2), at % 8)), F.lit(2)) == 1
            out = bit if out is None else out & bit
        return out


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    def has(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(~self.levels[i].has(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def encode(keys: DataFrame, n: int, bits: int, hashes: int, seed: int) -> Level:
    """A level over ``key``; its size follows the number of keys, and Spark builds the bitmaps."""
    size = max(64, 8 * math.ceil(n * bits / 8))
    level = Level(b"", size, hashes, seed)
    level.bits = bitmap(keys, level.positions(F.col("key")), size)
    return level


def build(listed: DataFrame, universe: DataFrame) -> Cascade | None:
    """The cascade of the listed keys over the universe; both have the column ``key``.

    Null keys are left out and repeated ones count once; without a listed key the
    one level is empty.  None if the levels would pass LITERAL_BYTES.
    """
    universe = cut(universe.select("key").where("key is not null").distinct())
    inside = cut(universe.join(listed.select("key").distinct(), "key", "left_semi"))
    outside = universe.join(inside, "key", "left_anti")
    out, used = Cascade(), 0
    while True:
        n = inside.count()
        bits, hashes = LATER if out.levels else FIRST
        used += n * bits // 8
        if used > LITERAL_BYTES:
            return None
        level = encode(inside, n, bits, hashes, len(out.levels))
        out.levels.append(level)
        wrong = cut(outside.where(level.has(F.col("key"))))
        if wrong.isEmpty():
            return out
        inside, outside = wrong, inside


def host(url: str) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for none."""
    rest = F.expr(f"if(instr(`{url}`, '://') > 0, substring(`{url}`, instr(`{url}`, '://') + 3), '')")
    found = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path(url: str) -> Column:
    """From the host's end up to ?, # or the end; empty for none."""
    rest = F.expr(f"if(instr(`{url}`, '://') > 0, substring(`{url}`, instr(`{url}`, '://') + 3), '')")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def domains(name: Column) -> Column:
    """A host and all of its parent domains."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def fitting(rules: list[tuple[str, str, str]], name: Column, way: Column) -> tuple[Column, Column]:
    """Of rules (verdict, host, path): the longest that fits, as text, and its verdict; nulls for none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, domain, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((name == domain) | name.endswith("." + domain)) & way.startswith(start)
        rule = F.when(fits, F.lit(domain + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` and host, path, rule, listed and verdict.

    ``listed`` has blocked domains in the column ``key``; a host is listed with any
    of its parent domains.  The longest fitting rule decides, else the list, and
    what is in neither is allowed.  A null url, or one without ://, has an empty
    host and path, fits no rule and isn't listed.  Rows are neither dropped nor
    merged; columns of the new names are replaced.
    """
    parsed = pages.withColumns({"__host": host(url), "__path": path(url)})
    parsed = parsed.drop("host", "path").withColumnsRenamed({"__host": "host", "__path": "path"})
    universe = parsed.select("host").distinct().select(F.explode(domains(F.col("host"))).alias("key"))
    cascade = build(listed, universe)
    if cascade is not None:
        parsed = parsed.withColumn("listed", F.exists(domains(F.col("host")), cascade.has))
    else:
        hit = parsed.select("host").distinct().select(F.col("host").alias("__own"), F.explode(domains(F.col("host"))).alias("key")).join(listed.select("key"), "key", "left_semi").select("__own").distinct()
        parsed = parsed.drop("listed").join(hit, F.col("host") == F.col("__own"), "left").withColumn("listed", F.col("__own").isNotNull()).drop("__own")
    rule, verdict = fitting(rules, F.col("host"), F.col("path"))
    return parsed.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))))


#: Rules of the query: verdict, host, path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Words that list a domain if they are a hyphenated part of its first label.
LISTED_WORDS = ["ad", "ads", "adult", "banner", "bet", "bets", "bingo", "casino", "clicks", "escort", "lottery", "loan", "loans", "pills", "poker", "porn", "slots", "spam", "track", "tracker", "viagra", "warez", "xxx"]


def advertised(pages: DataFrame, words: list[str] = LISTED_WORDS, url: str = "url") -> DataFrame:
    """The list of the query: domains of the corpus with one of the words in their first label; a null url has none, and repeats count once."""
    keys = pages.select(host(url).alias("host")).distinct().select(F.explode(domains(F.col("host"))).alias("key")).distinct()
    return keys.where(F.arrays_overlap(F.split(F.substring_index("key", ".", 1), "-"), F.array(*map(F.lit, words))) & F.col("key").contains("."))


def op6(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, listed."""
    own = pages.select("page_id", "url")
    return judge(own, RULES, advertised(own)).select("page_id", "host", "path", "rule", "verdict", "listed")
