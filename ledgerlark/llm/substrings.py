"""Substring dedup: a count-min prefilter, then an exact second pass.

Documents are dealt into chunks by doc_id, and the three passes read the same
exchange.

1. Each chunk sketches its windows: ``depth`` rows of counters, far wider than
   the number of windows, of which only the non-zero ones are sent, by ranges.
   Merging the ranges tells each chunk which of its counters other chunks share.
   A window's estimate is the least of its counters, so it is never too low.
2. Windows estimated repeated, and no others, are grouped exactly (96-bit
   hashes): inside a chunk first, then each chunk sends the first place of every
   distinct one, so a passage in a third of all documents sends one row a chunk.
3. Each chunk learns which of its windows start earlier elsewhere and drops the
   words that they and its own later repeats cover.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codecs import pack_flags, pack_sorted, planes, unpack_flags, unpack_sorted, unplanes
from .common import text_bytes
from .kernels import Hasher, mix, pieces, text_buffers, window_starts

NULL_ID = -(1 << 63)
SKETCH = "key int, chunk long, cells binary"
FLAGS = "chunk long, key int, flags binary"
ENTRIES = "key int, chunk long, first binary, second binary, doc binary, ids binary, place binary"
GONE = "chunk long, place binary"


class Chunk:
    """The words and windows of one chunk, documents in order of doc_id, then text."""

    def __init__(self, table: pa.Table, size: int):
        ids = pc.fill_null(table["doc_id"].cast(pa.int64()), NULL_ID)
        sortable = pa.table({"id": ids, "text": table["text"]})
        order = pc.sort_indices(sortable, [("id", "ascending"), ("text", "ascending")])
        self.table = table.take(order)
        self.ids = np.asarray(ids.combine_chunks())[np.asarray(order)]
        self.data, self.offsets, _ = text_buffers(self.table["text"])
        self.size, self.hasher = size, Hasher("plain")
        self.by_row = [0]

    def windows(self, second: bool = False) -> tuple[np.ndarray, ...]:
        """First words of all windows, their hashes, and second hashes if wanted."""
        other, places, hashes, seconds, before, self.by_row = Hasher("plain", 1), [], [], [], 0, [0]
        for i, j in pieces(self.offsets):
            words = self.hasher.words(self.data, self.offsets[i : j + 1])
            h = words.hashes()
            starts, _ = window_starts(words.by_row, self.size)
            places.append(starts + before)
            hashes.append(self.hasher.windows(h, self.size)[starts])
            if second:
                seconds.append(other.windows(mix(h ^ np.uint64(0xA5A5)), self.size)[starts])
            self.by_row += (words.by_row[1:] + before).tolist()
            before += len(words)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        return join(places, np.int64), join(hashes, np.uint64), join(seconds, np.uint64)


def cells_of(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(hashes ^ np.uint64(0x51ED270B * (row + 1))) >> np.uint64(64 - bits)


def by_range(cells: np.ndarray, bits: int, range_bits: int) -> list[tuple[int, slice]]:
    """Runs of sorted cells that share their leading ``range_bits``."""
    top = (cells >> np.uint64(bits - range_bits)).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(top)) + 1, [len(top)]]) if len(top) else [0]
    return [(int(top[a]), slice(int(a), int(b))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def plan_of(total: int, window: int, chunk_bytes: int, range_windows: int, slack: int) -> tuple[int, int, int]:
    """(chunks, counter bits, range bits) for so many bytes of text."""
    windows = max(1, total // 4)
    bits = max(16, math.ceil(math.log2(windows * slack)))
    ranges = min(bits - 8, 20, max(0, math.ceil(math.log2(max(1, windows / range_windows)))))
    return max(1, -(-total // chunk_bytes)), bits, ranges


def sketch_pass(size: int, depth: int, bits: int, range_bits: int):
    def sketch(key, table):
        _, hashes, _ = Chunk(table, size).windows()
        out = []
        for row in range(depth):
            cells = np.unique(cells_of(hashes, row, bits))
            for k, part in by_range(cells, bits, range_bits):
                out.append(((row << range_bits) + k, key[0].as_py(), pack_sorted(cells[part])))
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({"key": pa.array(cols[0], pa.int32()), "chunk": pa.array(cols[1], pa.int64()), "cells": pa.array(cols[2], pa.binary())})

    return sketch


def merge_sketches(key, table):
    """For each chunk, flags of the counters that another chunk raises too."""
    chunks, sent = table["chunk"].to_pylist(), [unpack_sorted(x) for x in table["cells"].to_pylist()]
    seen = np.sort(np.concatenate(sent))
    shared = np.unique(seen[1:][seen[1:] == seen[:-1]])
    out = []
    for chunk, cells in zip(chunks, sent, strict=True):
        at = np.searchsorted(shared, cells)
        flags = np.zeros(len(cells), bool)
        inside = at < len(shared)
        flags[inside] = shared[at[inside]] == cells[inside]
        if flags.any():
            out.append((chunk, pack_flags(flags)))
    return pa.table({"chunk": pa.array([x[0] for x in out], pa.int64()), "key": pa.array([key[0].as_py()] * len(out), pa.int32()), "flags": pa.array([x[1] for x in out], pa.binary())})


def exact_pass(size: int, depth: int, bits: int, range_bits: int):
    def find(key, docs, flags):
        out, me = [], key[0].as_py()
        chunk = Chunk(docs, size)
        places, first, second = chunk.windows(second=True)
        shared, repeated = np.ones(len(first), bool), np.ones(len(first), bool)
        known = dict(zip(flags["key"].to_pylist(), flags["flags"].to_pylist(), strict=True))
        for row in range(depth):
            cells, back, counts = np.unique(cells_of(first, row, bits), return_inverse=True, return_counts=True)
            elsewhere = np.zeros(len(cells), bool)
            for k, part in by_range(cells, bits, range_bits):
                if (got := known.get((row << range_bits) + k)) is not None:
                    elsewhere[part] = unpack_flags(got)
            shared &= elsewhere[back]
            repeated &= (elsewhere | (counts > 1))[back]
        places, first, second, shared = places[repeated], first[repeated], (second[repeated] >> np.uint64(32)).astype(np.uint32), shared[repeated]
        order = np.lexsort((places, second, first))
        places, first, second, shared = places[order], first[order], second[order], shared[order]
        later = np.zeros(len(first), bool)
        later[1:] = (first[1:] == first[:-1]) & (second[1:] == second[:-1])
        out.append((me % (1 << range_bits), me, None, None, None, None, pack_sorted(np.sort(places[later]))))
        send = ~later & shared
        places, first, second = places[send], first[send], second[send]
        doc = np.searchsorted(chunk.by_row, places, "right") - 1
        for k, part in by_range(first, 64, range_bits) if len(first) else []:
            used, at = np.unique(doc[part], return_inverse=True)
            out.append((k, me, pack_sorted(first[part]), second[part].tobytes(), planes(at), chunk.ids[used].tobytes(), planes(places[part])))
        names, kinds = zip(*[x.split() for x in ENTRIES.split(", ")], strict=True)
        return pa.table({n: pa.array([x[i] for x in out], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t]) for i, (n, t) in enumerate(zip(names, kinds, strict=True))})

    return find


def settle(key, table):
    """For each chunk, the windows that start earlier in another chunk, beside its own repeats."""
    gone, parts = [], []
    for r in table.to_pylist():
        if r["first"] is None:
            gone.append((r["chunk"], r["place"]))
        else:
            first = unpack_sorted(r["first"])
            ids = np.frombuffer(r["ids"], np.int64)[unplanes(r["doc"]).astype(np.int64)]
            parts.append((first, np.frombuffer(r["second"], np.uint32), ids, unplanes(r["place"]), np.full(len(first), r["chunk"])))
    if parts:
        first, second, ids, places, chunks = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((ids, second, first))
        first, second, places, chunks = first[order], second[order], places[order], chunks[order]
        late = np.zeros(len(first), bool)
        late[1:] = (first[1:] == first[:-1]) & (second[1:] == second[:-1])
        places, chunks = places[late], chunks[late]
        order = np.lexsort((places, chunks))
        places, chunks = places[order], chunks[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(chunks)) + 1, [len(chunks)]]) if len(chunks) else [0]
        gone += [(int(chunks[a]), pack_sorted(places[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table({"chunk": pa.array([x[0] for x in gone], pa.int64()), "place": pa.array([x[1] for x in gone], pa.binary())})


def cut_pass(size: int):
    def cut(key, docs, gone):
        chunk = Chunk(docs, size)
        removed = [unpack_sorted(x).astype(np.int64) for x in gone["place"].to_pylist()]
        removed = np.concatenate(removed) if removed else np.zeros(0, np.int64)
        before, n_words, n_removed, texts, spans = 0, [], [], [], []
        for i, j in pieces(chunk.offsets):
            words = chunk.hasher.words(chunk.data, chunk.offsets[i : j + 1])
            n = len(words)
            edge = np.zeros(n + 1, np.int64)
            here = removed[(removed >= before) & (removed < before + n)] - before
            np.add.at(edge, here, 1)
            np.add.at(edge, here + size, -1)
            kept = np.cumsum(edge[:n]) == 0
            kept_upto = np.concatenate([[0], np.cumsum(kept)])
            row_kept = np.diff(kept_upto[words.by_row])
            number = np.flatnonzero(kept)
            last = np.zeros(n, bool)
            ends = kept_upto[words.by_row[1:]] - 1
            last[number[ends[row_kept > 0]]] = True
            depth = np.zeros(len(words.folded) + 1, np.int8)
            depth[words.starts[kept]] += 1
            depth[words.ends[kept]] -= 1
            take = np.cumsum(depth[:-1], dtype=np.int8) > 0
            take[words.ends[kept & ~last]] = True
            text = words.folded[take]
            upto = np.concatenate([[0], np.cumsum(take)])[words.bounds]
            texts.append(pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(upto.astype(np.int64).tobytes()), pa.py_buffer(text.tobytes())))
            n_words.append(words.counts())
            n_removed.append(words.counts() - row_kept)
            turn = np.flatnonzero(np.diff(np.concatenate([[True], kept, [True]]).astype(np.int8)))
            starts, stops = turn[::2], turn[1::2]
            spans.append(_row_spans(starts, stops, words.by_row))
            before += n
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table(
            {
                "doc_id": chunk.table["doc_id"].cast(pa.int64()),
                "n_words": pa.array(join(n_words), pa.int64()),
                "n_removed": pa.array(join(n_removed), pa.int64()),
                "kept": pa.chunked_array(texts, pa.large_string()).cast(pa.string()),
                "removed": pa.chunked_array(spans, REMOVED),
            }
        )

    return cut


REMOVED = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _row_spans(starts: np.ndarray, stops: np.ndarray, by_row: np.ndarray) -> pa.Array:
    """Lists of removed word ranges by row; a range over several rows is cut at their edges."""
    edges = by_row[1:-1]
    cuts = edges[np.searchsorted(starts, edges, "right") > np.searchsorted(stops, edges, "right")] if len(starts) else edges[:0]
    cuts = np.unique(cuts)
    cuts = cuts[~np.isin(cuts, starts)]
    starts, stops = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([stops, cuts]))
    row = np.searchsorted(by_row, starts, "right") - 1
    counts = np.bincount(row, minlength=len(by_row) - 1)[: len(by_row) - 1]
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(starts - by_row[row], pa.int64()), pa.array(stops - by_row[row], pa.int64())], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def dedup_substrings(
    docs: DataFrame,
    window: int = 20,
    depth: int = 2,
    slack: int = 8,
    chunk_bytes: int = 8 << 20,
    range_windows: int = 2_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_removed, kept (remaining words joined by a space) and removed (word ranges).

    A word goes if a window of ``window`` words that covers it starts earlier
    too: in a smaller doc_id, or earlier in the document; all windows are judged
    on the input.  A null text has no words; a null doc_id counts as the
    smallest; rows of one doc_id go by text, and of equal rows the first stays.
    ``chunk_bytes`` bounds a task's memory (a longer text is a chunk's own size).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chunks, bits, range_bits = plan_of(text_bytes(rows), window, chunk_bytes, range_windows, slack)
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)))
    flags = (
        rows.groupBy("chunk")
        .applyInArrow(sketch_pass(window, depth, bits, range_bits), SKETCH)
        .groupBy("key")
        .applyInArrow(merge_sketches, FLAGS)
    )
    gone = (
        rows.groupBy("chunk")
        .cogroup(flags.groupBy("chunk"))
        .applyInArrow(exact_pass(window, depth, bits, range_bits), ENTRIES)
        .groupBy("key")
        .applyInArrow(settle, GONE)
    )
    out = "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start: long, end: long>>"
    return rows.groupBy("chunk").cogroup(gone.groupBy("chunk")).applyInArrow(cut_pass(window), out)
