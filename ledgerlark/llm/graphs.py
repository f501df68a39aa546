"""Connected components: in one task up to a bounded size, else by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def joined(u: np.ndarray, v: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels (the least number of each part) after joining u-v, given such labels."""
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        for end in (u, v):
            np.minimum.at(new, end, least)
            np.minimum.at(new, label[end], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, node) edges that join what the edges a-b join, one for each node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = joined(at[: len(a)], at[len(a) :], np.arange(len(nodes)))
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[other]], nodes[other]


def in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [[np.asarray(batch.column(c)) for c in ("lo", "hi")] for batch in batches]
    if ends:
        lo, hi = forest(*(np.concatenate(x) for x in zip(*ends, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["lo", "hi"])


def components(edges: DataFrame, most_rounds: int = 60, few: int = 1 << 20) -> DataFrame:
    """(node, component) for the ends of ``edges`` (a, b), both long; a component is named by its least node.

    Up to ``few`` distinct edges (16 MB) are joined by one task, more in rounds.
    Every round joins each node's neighbours to their least: first the greater
    ones, then the smaller ones, until nothing changes; rounds grow with the
    logarithm of the size.  Minima are pre-aggregated and stored before a join,
    so that both sides of it are plain shuffles, of which adaptive execution
    splits a hub's part.  Rounds are tables in the shared folder.
    """
    now = saved(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo < hi").distinct(), "edges")
    one = now.count() <= few
    if one:
        now = saved(now.coalesce(1).mapInArrow(in_one_task, "lo long, hi long"), "edges")
    mark = None
    for _ in range(0 if one else most_rounds):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = saved(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).filter("lo < hi").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.col("m").alias("lo"), F.explode(F.array("lo", "hi")).alias("hi")).filter("lo < hi").distinct()
        now = saved(small, "edges")
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark = seen
    else:
        if not one:
            raise RuntimeError("components did not settle")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct())
