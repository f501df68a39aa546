"""Approximate nearest neighbours by inner product on robust-pruned graphs.

Vectors are dealt into shards by hash.  Each shard is a directed graph: every
vector is inserted by a greedy search from the medoid whose visited vectors are
candidates; pruning keeps a candidate unless one already kept is nearer to it by
the factor ``alpha``, so edges stay diverse; edges go both ways and are pruned
again where a vector has too many.  A query beam-searches every shard.

Inner product becomes distance by one more coordinate, sqrt(most norm^2 -
norm^2), for the stored vectors and 0 for queries.  Equal vectors are one node:
its least ids stand for it, so a vector in a third of all rows is no hub.
Searches run in step for many queries at once, as array operations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved


def beam_search(vectors: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(nodes [query, beam] by distance, -1 where none; their distances; nodes visited at each step).

    ``edges`` is [node, degree], -1 where none.  Every step each query expands
    the nearest node of its beam that it has not yet visited.
    """
    q = len(queries)
    node = np.full((q, beam), -1, np.int64)
    dist = np.full((q, beam), np.inf, np.float32)
    done = np.ones((q, beam), bool)
    node[:, 0] = start
    dist[:, 0] = ((vectors[start] - queries) ** 2).sum(axis=1)
    done[:, 0] = False
    live, visits = np.arange(q), []
    while len(live):
        open_ = np.where(done[live], np.inf, dist[live])
        pick = open_.argmin(axis=1)
        live, pick = (x[np.isfinite(open_[np.arange(len(live)), pick])] for x in (live, pick))
        if not len(live):
            break
        at = node[live, pick]
        done[live, pick] = True
        step = np.full(q, -1, np.int64)
        step[live] = at
        visits.append(step)
        next_ = edges[at]
        d = ((vectors[next_] - queries[live][:, None, :]) ** 2).sum(axis=2)
        d[next_ < 0] = np.inf
        known = (next_[:, :, None] == node[live][:, None, :]).any(axis=2)
        d[known] = np.inf
        all_node = np.concatenate([node[live], next_], axis=1)
        all_dist = np.concatenate([dist[live], d.astype(np.float32)], axis=1)
        all_done = np.concatenate([done[live], np.zeros(d.shape, bool)], axis=1)
        keep = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
        row = np.arange(len(live))[:, None]
        node[live], dist[live], done[live] = all_node[row, keep], all_dist[row, keep], all_done[row, keep]
        node[live] = np.where(np.isfinite(dist[live]), node[live], -1)
        done[live] |= ~np.isfinite(dist[live])
    order = np.argsort(dist, axis=1, kind="stable")
    row = np.arange(q)[:, None]
    return node[row, order], dist[row, order], visits


def robust_prune(vectors: np.ndarray, owner: int, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """At most ``degree`` diverse candidates, nearest first."""
    candidates = np.unique(candidates[(candidates >= 0) & (candidates != owner)])
    d = ((vectors[candidates] - vectors[owner]) ** 2).sum(axis=1)
    order = np.argsort(d, kind="stable")
    candidates, d = candidates[order], d[order]
    between = None
    alive, kept = np.ones(len(candidates), bool), []
    v = vectors[candidates]
    norms = (v**2).sum(axis=1)
    between = norms[:, None] + norms[None, :] - 2 * v @ v.T
    for k in range(len(candidates)):
        if alive[k]:
            kept.append(k)
            if len(kept) == degree:
                break
            alive &= ~(alpha * between[k] <= d)
    return candidates[kept]


def build_graph(vectors: np.ndarray, degree: int = 24, beam: int = 48, alpha: float = 1.44, batch: int = 512) -> tuple[np.ndarray, int]:
    """(edges [node, degree], start) of one shard; ``alpha`` is for squared distances."""
    n = len(vectors)
    start = int(((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1).argmin())
    edges = np.full((n, degree), -1, np.int64)
    order = np.random.default_rng(7).permutation(n)
    # the first vectors are joined to each other, the rest inserted in growing batches
    head = order[: min(n, degree + 1)]
    for i in head:
        others = robust_prune(vectors, int(i), np.append(head, start), alpha, degree)
        edges[i, : len(others)] = others
    if start not in head:
        others = robust_prune(vectors, start, head, alpha, degree)
        edges[start, : len(others)] = others
    at = len(head)
    while at < n:
        some = order[at : at + min(batch, max(8, at // 2))]
        at += len(some)
        nodes, _, visits = beam_search(vectors, edges, start, vectors[some], beam)
        seen = np.concatenate([nodes, np.stack(visits, axis=1)], axis=1)
        back: dict[int, list[int]] = {}
        for row, i in enumerate(some.tolist()):
            kept = robust_prune(vectors, i, np.concatenate([seen[row], edges[i]]), alpha, degree)
            edges[i] = -1
            edges[i, : len(kept)] = kept
            for j in kept.tolist():
                back.setdefault(j, []).append(i)
        for j, new in back.items():
            room = np.flatnonzero(edges[j] < 0)
            new = [i for i in new if i not in edges[j]]
            if len(new) <= len(room):
                edges[j, room[: len(new)]] = new
            else:
                kept = robust_prune(vectors, j, np.concatenate([edges[j], new]), alpha, degree)
                edges[j] = -1
                edges[j, : len(kept)] = kept
    return edges, start


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.asarray(column.flatten(), np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def lifted(vectors: np.ndarray, most: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(most - (vectors**2).sum(axis=1), 0.0))
    return np.column_stack([vectors, rest]).astype(np.float32)


def builder(most: float, degree: int, beam: int, alpha: float):
    def run(key, table):
        vectors = matrix(table["vector"])
        edges, start = build_graph(lifted(vectors, most), degree, beam, alpha)
        row = [key[0].as_py(), len(vectors), vectors.shape[1], start, vectors.tobytes(), edges.astype(np.int32).tobytes(), np.asarray(table["node"].combine_chunks()).tobytes()]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["shard", "n", "dim", "start", "vectors", "edges", "nodes"])

    return run


def searcher(most: float, beam: int, k: int, rows_at_once: int = 1024):
    def run(key, graph, queries):
        ids, nodes, scores = [], [], []
        if graph.num_rows and queries.num_rows:
            g = graph.slice(0, 1).to_pylist()[0]
            vectors = np.frombuffer(g["vectors"], np.float64).reshape(g["n"], g["dim"])
            edges = np.frombuffer(g["edges"], np.int32).reshape(g["n"], -1).astype(np.int64)
            names = np.frombuffer(g["nodes"], np.int64)
            stored, asked = lifted(vectors, most), matrix(queries["vector"])
            query_ids = np.asarray(queries["query_id"].combine_chunks())
            for i in range(0, len(asked), rows_at_once):
                q = asked[i : i + rows_at_once]
                found, _, _ = beam_search(stored, edges, g["start"], np.column_stack([q, np.zeros(len(q))]).astype(np.float32), min(beam, max(k, g["n"])))
                row, col = np.nonzero(found >= 0)
                got = found[row, col]
                score = np.einsum("ij,ij->i", q[row], vectors[got])
                order = np.lexsort((names[got], -score, row))
                row, got, score = row[order], got[order], score[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                top = rank <= k  # one more than asked for: the query itself may be among them
                ids.append(query_ids[i + row[top]])
                nodes.append(names[got[top]])
                scores.append(score[top])
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return pa.table({"query_id": pa.array(join(ids, np.int64), pa.int64()), "node": pa.array(join(nodes, np.int64), pa.int64()), "score": pa.array(join(scores, np.float64), pa.float64())})

    return run


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector double[]) of rows with an id and a finite, non-zero vector."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.filter("vec_id IS NOT NULL AND vector IS NOT NULL").filter(~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0))


def nearest(vectors: DataFrame, is_query, k: int = 20, degree: int = 32, build_beam: int = 64, beam: int = 160, alpha: float = 1.44, shard_vectors: int = 16_000, query_block: int = 16_384, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` nearest other rows of each query by inner product.

    ``is_query`` is a predicate on ``vec_id``.  Ties go to the smaller id;
    fewer rows than ``k`` are all returned.  Null, zero and non-finite vectors
    take no part, nor do those of another length than the most frequent one.
    Repeated rows are candidates each, but a query's own id is none.
    """
    rows = valid(vectors, id_col, vector_col)
    usual = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    rows = rows.filter(F.size("vector") == (usual["length"] if usual else 0))
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    first = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    members = rows.withColumn("place", first).filter(F.col("place") <= k + 1)
    members = saved(members.withColumn("node", F.first("vec_id").over(Window.partitionBy("vector").orderBy("vec_id"))), "vector-members")
    facts = members.filter("place = 1").agg(F.count("*"), F.max(squares)).first()
    shards = max(1, -(-facts[0] // shard_vectors))
    most = facts[1] or 1.0
    dealt = members.filter("place = 1").select("node", "vector", F.pmod(F.xxhash64("node"), F.lit(shards)).alias("shard"))
    graph = "shard long, n long, dim long, start long, vectors binary, edges binary, nodes binary"
    index = saved(dealt.groupBy("shard").applyInArrow(builder(most, degree, build_beam, alpha), graph), "vector-graphs")

    queries = saved(rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "vector"), "vector-queries")
    blocks = max(1, -(-queries.count() // query_block))
    block = lambda x: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(x - 1).cast("long")))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("shard", block(shards))
    found = (
        index.withColumn("block", block(blocks))
        .groupBy("shard", "block")
        .cogroup(asked.groupBy("shard", "block"))
        .applyInArrow(searcher(most, beam, k), "query_id long, node long, score double")
    )
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "node"))
    found = found.distinct().withColumn("place", best).filter(F.col("place") <= k + 1).drop("place")
    each = found.join(members.select("node", "vec_id"), "node").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return each.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
