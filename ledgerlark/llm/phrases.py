"""Benchmark decontamination on a positional inverted index.

The index is a Parquet table of segments.  A segment holds some whole documents
and, for each of their terms (64-bit word hashes, sorted), the ascending list of
positions.  A phrase is looked up in a segment by its rarest term there: that
term's positions, shifted by its offset, are intersected with the shifted lists
of the other terms, rarest first.  All phrases of a block are intersected at
once, so the cost follows the posting lists, not the number of phrases.
Documents never leave their segment, so no posting is shuffled.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codecs import pack_sorted, planes, unpack_sorted, unplanes
from .common import saved, shipped, text_bytes
from .kernels import Hasher, pieces, ragged, returned, text_buffers

INDEX = "doc_ids array<long>, words binary, terms binary, counts binary, postings binary"
MATCHES = "segment long, place long, doc_id long, n_words long, n_hit long, hits array<struct<item: string, start: long, end: long>>"
HITS = pa.list_(pa.struct([("item", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def segment(ids: pa.Array, data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> tuple:
    """(ids, words by document, terms, list lengths, positions by list)."""
    hashes, counts = [], []
    for i, j in pieces(offsets):
        words = hasher.words(data, offsets[i : j + 1])
        hashes.append(words.hashes())
        counts.append(words.counts())
    hashes, counts = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    step = np.diff(order, prepend=0)
    step[first] = order[first]
    return ids.to_pylist(), planes(counts), pack_sorted(ordered[first]), planes(np.diff(np.append(first, len(ordered)))), planes(step)


def index_batches(segment_bytes: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher("alnum")
        for batch in batches:
            data, offsets, _ = text_buffers(batch.column("text"))
            for i, j in pieces(offsets, segment_bytes):
                ids = batch.column("doc_id").slice(i, j - i)
                row = segment(ids, data, offsets[i : j + 1], hasher)
                kinds = [pa.list_(pa.int64())] + [pa.binary()] * 4
                names = [x.split()[0] for x in INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)
        returned()

    return build


def build_index(docs: DataFrame, segment_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored positional index of all words of whole texts (a null text has none).

    Words: runs of digits, a-z (A-Z lower-cased) and non-ASCII characters.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return saved(rows.mapInArrow(index_batches(segment_bytes), INDEX).withColumn("segment", F.monotonically_increasing_id()), "phrase-index")


class Phrases:
    """Windows of the items' words: every ``size`` consecutive ones, or a shorter item as a whole."""

    def __init__(self, items: list, texts: list, size: int):
        data, offsets, _ = text_buffers(pa.array(texts, pa.string()))
        words = Hasher("alnum").words(data, offsets)
        hashes = words.hashes()
        self.items = ["null" if i is None else str(i) for i in items]
        starts, lengths, owners = [], [], []
        for k, (a, b) in enumerate(zip(words.by_row[:-1], words.by_row[1:], strict=True)):
            n = min(size, int(b - a))
            if n:
                s = np.arange(a, b - n + 1)
                starts.append(s)
                lengths.append(np.full(len(s), n))
                owners.append(np.full(len(s), k))
        none = np.zeros(0, np.int64)
        self.start, self.length, self.owner = (np.concatenate(x) if x else none for x in (starts, lengths, owners))
        self.terms, self.word = np.unique(hashes, return_inverse=True)


class Segment:
    """A segment's postings, ready for lookups."""

    def __init__(self, row: dict):
        self.number = row["segment"]
        self.ids = row["doc_ids"]
        self.words = unplanes(row["words"]).astype(np.int64)
        self.upto = np.concatenate([[0], np.cumsum(self.words)])
        self.terms = unpack_sorted(row["terms"])
        self.counts = unplanes(row["counts"]).astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        step = unplanes(row["postings"]).astype(np.int64)
        run = np.cumsum(step)
        base = run[self.first] - step[self.first] if len(self.first) else run[:0]
        self.positions = run - np.repeat(base, self.counts)
        self.shift = int(self.upto[-1]).bit_length()
        self.keys = (np.repeat(np.arange(len(self.terms)), self.counts) << self.shift) | self.positions

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Number of each term here, or -1."""
        at = np.searchsorted(self.terms, terms)
        ok = at < len(self.terms)
        ok[ok] = self.terms[at[ok]] == terms[ok]
        return np.where(ok, at, -1)

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        inside = (position >= 0) & (position < self.upto[-1])
        want = (term << self.shift) | np.where(inside, position, 0)
        at = np.minimum(np.searchsorted(self.keys, want), max(0, len(self.keys) - 1))
        return inside & (self.keys[at] == want) if len(self.keys) else np.zeros(len(want), bool)

    def doc(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.upto, position, "right") - 1

    def phrases(self, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(window, first position) of all exact occurrences inside one document."""
        here = self.find(p.terms)
        word = ragged(p.start, p.length)
        window = np.repeat(np.arange(len(p.start)), p.length)
        term = here[p.word[word]] if len(word) else word
        offset = word - p.start[window]
        gone = np.zeros(len(p.start), bool)
        gone[window[term < 0]] = True
        keep = ~gone[window]
        window, term, offset = window[keep], term[keep], offset[keep]
        order = np.lexsort((self.counts[term], window)) if len(term) else np.zeros(0, np.int64)
        window, term, offset = window[order], term[order], offset[order]
        begin = np.flatnonzero(np.diff(window, prepend=-1))  # the rarest term of each window comes first
        w, rare = window[begin], term[begin]
        size = self.counts[rare]
        at = self.positions[ragged(self.first[rare], size)] - np.repeat(offset[begin], size)
        which = np.repeat(np.arange(len(begin)), size)
        lengths = p.length[w] if len(w) else w
        for j in range(1, int(lengths.max()) if len(lengths) else 0):
            more = lengths[which] > j
            k = begin[which] + np.where(more, j, 0)
            ok = ~more | self.has(term[k], at + offset[k])
            at, which = at[ok], which[ok]
        ok = at >= 0
        at, which = at[ok], which[ok]
        inside = self.doc(at) == self.doc(at + lengths[which] - 1) if len(at) else np.zeros(0, bool)
        return w[which[inside]], at[inside]

    def near(self, p: Phrases, within: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) where all terms lie within so many words of an occurrence of the rarest."""
        here = self.find(p.terms)
        found_w, found_p = [], []
        for w, (s, n) in enumerate(zip(p.start, p.length, strict=True)):
            terms = np.unique(here[p.word[s : s + n]])
            if terms[0] < 0:
                continue
            terms = terms[np.argsort(self.counts[terms], kind="stable")]
            at = self.positions[self.first[terms[0]] : self.first[terms[0]] + self.counts[terms[0]]]
            doc = self.doc(at)
            low = np.maximum(at - within, self.upto[doc])
            high = np.minimum(at + within, self.upto[doc + 1] - 1)
            ok = np.ones(len(at), bool)
            for t in terms[1:]:
                list_ = self.positions[self.first[t] : self.first[t] + self.counts[t]]
                ok &= np.searchsorted(list_, low, "left") < np.searchsorted(list_, high, "right")
            found_w.append(np.full(int(ok.sum()), w))
            found_p.append(at[ok])
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return join(found_w), join(found_p)

    def report(self, p: Phrases, window: np.ndarray, at: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
        """One row per document: its words, those inside any match, and the matches."""
        total = int(self.upto[-1])
        edge = np.zeros(total + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length, -1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:total]) > 0)])
        doc = self.doc(at)
        order = np.lexsort((at, p.owner[window], doc)) if len(at) else at
        doc, owner, at, length = doc[order], p.owner[window][order] if len(at) else at, at[order], length[order]
        # overlapping windows of one item make one match
        end = at + length
        fresh = np.ones(len(at), bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (owner[1:] != owner[:-1]) | (at[1:] > end[:-1])
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(at)) - 1 if len(first) else first
        counts = np.bincount(doc[first], minlength=len(self.words)) if len(first) else np.zeros(len(self.words), np.int64)
        items = pa.array([p.items[i] for i in owner[first]], pa.string())
        base = self.upto[doc[first]]
        values = pa.StructArray.from_arrays([items, pa.array(at[first] - base, pa.int64()), pa.array(end[last] - base, pa.int64())], names=["item", "start", "end"])
        hits = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)
        n_hit = np.diff(covered[self.upto])
        n = len(self.words)
        longs = [pa.array(c, pa.int64()) for c in (np.full(n, self.number), np.arange(n), self.ids, self.words, n_hit)]
        return pa.RecordBatch.from_arrays(longs + [hits.cast(HITS)], names=["segment", "place", "doc_id", "n_words", "n_hit", "hits"])


def lookup(phrases, within: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pickle.loads(phrases.value)
        for batch in batches:
            for i in range(batch.num_rows):
                s = Segment(batch.slice(i, 1).to_pylist()[0])
                window, at = s.phrases(p) if within is None else s.near(p, within)
                yield s.report(p, window, at, p.length[window] if within is None and len(window) else np.ones(len(window), np.int64))
        returned()

    return run


def search(index: DataFrame, items: DataFrame, size: int = 10, within: int | None = None, block_bytes: int = 32 << 20, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit and hits (item, first word, end) of every indexed document.

    A hit is an exact occurrence of ``size`` consecutive words of an item, or of
    a whole shorter item; a null or empty item has none.  With ``within``, a hit
    is instead a place where all words of such a window lie within so many words
    of its rarest one.  Items reach the executors in blocks of at most
    ``block_bytes``; with several blocks the rows of a document (its segment and
    place there, since a doc_id may be null or repeat) are merged.
    """
    spark = index.sparkSession
    items = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    blocks = max(1, -(-text_bytes(items) // block_bytes))
    found = []
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        rows = part.collect()
        phrases = Phrases([r["item"] for r in rows], [r["text"] for r in rows], size)
        found.append(index.mapInArrow(lookup(shipped(spark, phrases), within), MATCHES))
    if blocks == 1:
        return found[0].drop("segment", "place")
    union = found[0]
    for f in found[1:]:
        union = union.unionByName(f)
    hits = F.array_sort(F.flatten(F.collect_list("hits")))
    merged = union.groupBy("segment", "place", "doc_id", "n_words").agg(hits.alias("hits"))
    covered = F.aggregate(
        F.array_sort(F.transform("hits", lambda h: F.struct(h["start"].alias("s"), h["end"].alias("e")))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda a, h: F.struct((a["n"] + F.greatest(h["e"] - F.greatest(h["s"], a["upto"]), F.lit(0))).cast("long").alias("n"), F.greatest(a["upto"], h["e"]).alias("upto")),
    )["n"]
    return merged.select("doc_id", "n_words", covered.alias("n_hit"), "hits")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, **options) -> DataFrame:
    """doc_id, n_words, n_hit, items (distinct, sorted), hits and contaminated of every document."""
    ids = {k: options.pop(k) for k in ("id_col", "segment_bytes") if k in options}
    found = search(build_index(docs, **ids), items, size, **options)
    return found.withColumns({"items": F.array_sort(F.array_distinct("hits.item")), "contaminated": F.col("n_hit") > 0})
