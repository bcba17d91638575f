"""Whether two results (id, value) agree: exactly, within a tolerance, or up to the names of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _joined(a: DataFrame, b: DataFrame) -> DataFrame:
    named = lambda df, v: df.select(F.col(df.columns[0]).alias("id"), F.col(df.columns[1]).alias(v), F.lit(True).alias(f"in_{v}"))
    return named(a, "x").join(named(b, "y"), "id", "full")


def exact(a: DataFrame, b: DataFrame) -> bool:
    return _joined(a, b).where("in_x is null or in_y is null or not (x <=> y)").isEmpty()


def within(a: DataFrame, b: DataFrame, tolerance: float = 1e-4, tiny: float = 1e-10) -> bool:
    """Relative difference at most ``tolerance``; infinities equal themselves, and values below ``tiny`` each other."""
    infinite = (F.abs("x") == float("inf")) | (F.abs("y") == float("inf"))
    close = F.when(infinite, F.col("x") == F.col("y")).otherwise((F.abs(F.col("x") - F.col("y")) <= tolerance * F.greatest(F.abs("x"), F.abs("y"))) | (F.greatest(F.abs("x"), F.abs("y")) < tiny))
    return _joined(a, b).where(F.col("in_x").isNull() | F.col("in_y").isNull() | ~F.coalesce(close, F.lit(False))).isEmpty()


def isomorphic(a: DataFrame, b: DataFrame) -> bool:
    """The same ids in the same groups, whatever the groups are called."""
    both = _joined(a, b)
    if not both.where("in_x is null or in_y is null").isEmpty():
        return False
    pairs = both.select("x", "y").distinct()
    once = lambda c: pairs.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    return once("x") and once("y")
