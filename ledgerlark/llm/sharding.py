"""Sharding by histogram sort.

Rows are ordered by (xxhash64 of the text, doc_id), so equal texts lie side by
side.  Exact bytes and rows are counted in the cells between candidate key
boundaries over all partitions; a cell that holds more bytes than the tolerance
is probed again between the least and greatest key it really holds, until every
cell is within tolerance or holds a single key.  Shard splitters are the cell
edges nearest to equal byte shares.  Then the rows are exchanged once, by cell,
and numbered inside: the counts give each cell's first slot.

Only cells reach the driver: about ``probes`` and one for each ``cell_bytes``.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _edges(first: tuple[int, int], last: tuple[int, int], parts: int) -> list[tuple[int, int]]:
    """Lower bounds of at most ``parts`` cells between two keys, both included."""
    axis = 0 if first[0] != last[0] else 1
    lo, hi = first[axis], last[axis]
    cuts = sorted({lo + (hi - lo + 1) * k // parts for k in range(1, parts)} - {lo})
    return [first] + [(c, LEAST) if axis == 0 else (first[0], c) for c in cuts]


def constant(rows: list[tuple[int, int]]) -> Column:
    """An array of (a, b) pairs as one literal, which the optimiser folds."""
    return F.from_json(F.lit(json.dumps([{"a": int(x), "b": int(y)} for x, y in rows])), "array<struct<a: bigint, b: bigint>>")


def cell_of(edges: list[tuple[int, int]], k1: str = "k1", k2: str = "k2") -> Column:
    """Number of the cell of a key: the last whose lower bound is at or below the key, by binary search."""
    bounds, key = constant(edges), F.struct(F.col(k1).alias("a"), F.col(k2).alias("b"))
    steps = F.array(*[F.lit(1 << i) for i in range(max(1, len(edges) - 1).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda i, s: F.when(F.get(bounds, i + s) <= key, i + s).otherwise(i))


def _after(key: tuple[int, int]) -> tuple[int, int]:
    return (key[0], key[1] + 1) if key[1] < MOST else (key[0] + 1, LEAST)


def histogram_cells(keys: DataFrame, tolerance: float, probes: int) -> list[tuple[tuple[int, int], int, int]]:
    """(lower bound, bytes, rows) of all cells in key order; ``keys`` has k1, k2, size."""
    cells: dict[tuple[int, int], tuple[int, int]] = {}
    live = _edges((LEAST, LEAST), (MOST, MOST), probes)
    closed: set[tuple[int, int]] = set()  # edges of regions that earlier rounds have counted
    while live:
        edges = sorted({*live, *closed, (LEAST, LEAST)})
        counted = set(live)
        got = (
            keys.groupBy(cell_of(edges).alias("cell"))
            .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min(F.struct("k1", "k2")).alias("lo"), F.max(F.struct("k1", "k2")).alias("hi"))
            .collect()
        )
        live, closed = [], set()
        for r in got:
            if edges[r["cell"]] not in counted:
                continue
            lo, hi = tuple(r["lo"]), tuple(r["hi"])
            if r["bytes"] > tolerance and lo != hi:
                live += _edges(lo, hi, int(min(64, 2 + 4 * r["bytes"] / tolerance)))
                if hi != (MOST, MOST):
                    closed.add(_after(hi))
            else:
                cells[lo] = (r["bytes"], r["rows"])
        closed -= set(live)
    return [(k, *cells[k]) for k in sorted(cells)]


def shard(
    docs: DataFrame,
    shards: int = 16,
    size_col: str | None = None,
    key_col: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    tolerance: float = 0.005,
    probes: int = 4096,
    cell_bytes: int = 256 << 20,
) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 in each shard).

    Shards hold nearly equal bytes: each splitter misses its share by at most
    half a cell, a cell being ``tolerance`` of a shard's bytes or one key.  A
    row's size is ``size_col``, else the text's UTF-8 bytes plus 1 (null: 1).
    Keys are ``key_col``, else xxhash64 of the text (null: 0); then the id (null
    sorts first).  Rows alike in both stay together up to ``shards`` rows; more
    are split by number where they are beyond the tolerance.
    An empty table has no shards.  Other columns pass through; the columns
    ``shard`` and ``slot`` are replaced, names starting ``__`` are reserved.
    """
    size = F.col(size_col) if size_col else F.coalesce(F.octet_length(text_col), F.lit(0)) + 1
    k1 = F.col(key_col) if key_col else F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.xxhash64(text_col))
    k2 = F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST).cast("long"))
    rows = docs.withColumns({"__k1": k1.cast("long"), "__k2": k2, "__size": size.cast("long")})
    keys = saved(rows.select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.col("__size").alias("size")), "shard-keys")
    total, count = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    most = min(max(1.0, total / shards * tolerance), float(cell_bytes))
    cells = histogram_cells(keys, most, max(probes, 2 * total // cell_bytes)) if count else []

    if not cells:
        return docs.withColumns({"shard": F.lit(None).cast("int"), "slot": F.lit(None).cast("long")}).limit(0)
    # a cell beyond the tolerance has one key, so its rows have one text and one size: it is cut by their numbers
    base, per, parts = [], [], []
    for _, size_, n in cells:
        k = max(1, int(most * n / size_)) if size_ > most and n > shards else n
        base.append(len(parts))
        per.append(k)
        parts += [(size_ / n * min(k, n - i), min(k, n - i)) for i in range(0, n, k)]
    ends = np.cumsum([x[0] for x in parts])
    cut = [0]
    for s in range(1, shards):
        want = total * s / shards
        i = int(np.searchsorted(ends, want))
        if i < len(ends) and abs(ends[i] - want) <= abs((ends[i - 1] if i else 0) - want):
            i += 1
        cut.append(max(cut[-1], i))
    of_part = np.searchsorted(cut, np.arange(len(parts)), "right") - 1
    before = np.concatenate([[0], np.cumsum([x[1] for x in parts])]).astype(np.int64)
    first = [int(before[i] - before[cut[s]]) for i, s in enumerate(of_part)]

    edges = [c[0] for c in cells]
    cuts = constant(list(zip(base, per, strict=True)))
    facts = constant(list(zip(of_part.tolist(), first, strict=True)))

    inside = Window.partitionBy("__cell").orderBy("__k1", "__k2")
    placed = (
        rows.withColumn("__cell", cell_of(edges, "__k1", "__k2"))
        .withColumns({"__row": (F.row_number().over(inside) - 1).cast("long"), "__cut": F.get(cuts, F.col("__cell"))})
        .withColumn("__facts", F.get(facts, (F.col("__cut.a") + F.floor(F.col("__row") / F.col("__cut.b"))).cast("int")))
        .withColumns({"shard": F.col("__facts.a").cast("int"), "slot": F.col("__facts.b") + F.col("__row") % F.col("__cut.b")})
    )
    return placed.drop("__k1", "__k2", "__size", "__cell", "__row", "__cut", "__facts")
