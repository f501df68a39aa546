"""Band joins: numbers within a tolerance, as an equi-join on buckets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, tolerance: float, on: list[str] = (), how: str = "inner") -> DataFrame:
    """Pairs with ``abs(left - right) <= tolerance`` in doubles, and equal ``on`` columns.

    Buckets are a little wider than the tolerance, so that rounding at an edge
    cannot part two neighbours; the left row looks into three buckets.  ``how``
    is inner, left_semi or left_anti; nulls never match.
    """
    width = max(tolerance * 1.001, math.ulp(1.0))
    bucket = lambda c: F.floor(c / F.lit(width))
    r = right.filter(F.col(right_value).isNotNull()).withColumn("__bucket", bucket(F.col(right_value)))
    near = lambda a, b: F.abs(a - b) <= F.lit(float(tolerance))
    if how == "inner":
        looks = F.explode(F.sequence(bucket(F.col(left_value)) - 1, bucket(F.col(left_value)) + 1))
        l = left.filter(F.col(left_value).isNotNull()).withColumn("__bucket", looks)  # noqa: E741
        return l.join(r, ["__bucket", *on]).filter(near(F.col(left_value), F.col(right_value))).drop("__bucket")
    keyed = left.withColumn("__row", F.monotonically_increasing_id())
    hit = band_join(keyed.select("__row", left_value, *on), right.select(F.col(right_value), *on), left_value, right_value, tolerance, on).select("__row").distinct()
    return keyed.join(hit, "__row", how).drop("__row")


def islands(df: DataFrame, value: Column, gap: float, within: list[str], name: str = "island") -> DataFrame:
    """Numbers the runs of ``value`` in which neighbours lie at most ``gap`` apart."""
    w = Window.partitionBy(*within).orderBy(value)
    fresh = F.coalesce(value - F.lag(value).over(w) > F.lit(gap), F.lit(False)).cast("long")
    return df.withColumn("__fresh", fresh).withColumn(name, F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__fresh")


def first_by(df: DataFrame, keys: list[str], order: list[Column], most: int = 1) -> DataFrame:
    """The first rows of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") <= most).drop("__n")


def tied_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """All rows of each key that tie for the first place."""
    return df.withColumn("__n", F.rank().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def only_pairs(df: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """Pairs that are the only one on both sides."""
    counts = {"__l": F.count("*").over(Window.partitionBy(*left)), "__r": F.count("*").over(Window.partitionBy(*right))}
    return df.withColumns(counts).filter("__l = 1 AND __r = 1").drop("__l", "__r")


def claimed_once(df: DataFrame, groups: list[str], order: list[str], unique: list[list[str]]) -> DataFrame:
    """Greedy choice in ``order``: a row is taken unless an earlier taken one has an equal key of ``unique``.

    Sequential inside a group by its nature; groups are independent.
    """
    schema = df.schema

    def choose(rows):
        rows = rows.sort_values(order, kind="stable")
        used, keep = [set() for _ in unique], []
        keys = [list(zip(*[rows[c] for c in cols], strict=True)) for cols in unique]
        for i in range(len(rows)):
            take = all(k[i] not in u for k, u in zip(keys, used, strict=True))
            keep.append(take)
            if take:
                for k, u in zip(keys, used, strict=True):
                    u.add(k[i])
        return rows[keep]

    return df.groupBy(*groups).applyInPandas(choose, schema)
