"""N-gram Jaccard join on a count-vector R-tree.

A document's set holds the hashes of its distinct word shingles.  Hashing the
shingles into groups gives a point of group counts.  The overlap of two sets is
at most the sum of their coordinate minima, and of two boxes of an R-tree at
most the sum of the minima of their upper corners; pairs and boxes that cannot
reach the threshold are pruned, the rest verified on the sets.

One R-tree over all points would prune next to nothing (see the README), so the
points are indexed by shingle: with shingles in one order, the rarest first, two
linked sets share one among the first few of each (:func:`prefixes`).  Each
shingle's points are joined by the bound, through an R-tree where they are many;
what the bound connects is a cluster, and each cluster's sets are verified.

Equal sets are one node, named by a hash of the set, so that neither copies nor
missing or repeated ids matter before the last step.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codecs import pack_sorted, planes, squeeze, unpack_sorted, unplanes, unsqueeze
from .common import saved, text_bytes
from .graphs import components, forest, joined
from .kernels import Hasher, mix, pieces, ragged, returned, text_buffers, window_starts

DIMS = (64, 256, 1024)  # groups of sets of up to DIM_SIZES shingles
DIM_SIZES = (512, 4096, 1 << 62)
LEAF = 32
SKETCH_PARTS = 64
SETS = "doc_id long, text_key long, n_shingles long, sig_a long, sig_b long, part int, counts binary"
KEYS = "range int, keys binary, doc binary, role binary, nodes binary, sizes binary, points binary"
POINTS = "cluster long, node long, shingles binary"
EDGES = "a long, b long"


class Shingles:
    """Sorted distinct shingle hashes by row."""

    def __init__(self, hasher: Hasher, data: np.ndarray, offsets: np.ndarray, size: int):
        words = hasher.words(data, offsets)
        h = words.hashes()
        starts, rows = window_starts(words.by_row, size)
        values = hasher.windows(h, size)[starts]
        counts = words.counts()
        for n in range(1, size):  # a shorter text is one shingle
            short = np.flatnonzero(counts == n)
            if len(short):
                whole = hasher.windows(h, n)[words.by_row[:-1][short]]
                values = np.append(values, mix(whole ^ np.uint64(0xC2B2AE3D * n)))
                rows = np.append(rows, short)
        order = np.lexsort((values, rows))
        values, rows = values[order], rows[order]
        fresh = np.ones(len(values), bool)
        fresh[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
        self.values, self.rows = values[fresh], rows[fresh]
        self.at = np.searchsorted(self.rows, np.arange(len(offsets)))

    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def sums(self, salt: int) -> np.ndarray:
        out = np.zeros(len(self.at) - 1, np.uint64)
        np.add.at(out, self.rows, mix(self.values ^ np.uint64(salt)))
        return out

    def signatures(self) -> tuple[np.ndarray, np.ndarray]:
        return self.sums(0x1B873593), self.sums(0xCC9E2D51)


def unseen(a: np.ndarray, b: np.ndarray, seen: set) -> np.ndarray:
    """Rows whose signature is not in ``seen``, which grows by them."""
    first = []
    for k, sig in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        if sig not in seen:
            seen.add(sig)
            first.append(k)
    return np.array(first, np.int64)


def cells(values: np.ndarray, bits: int) -> np.ndarray:
    return (mix(values ^ np.uint64(0x51ED270B)) >> np.uint64(64 - bits)).astype(np.int64)


def set_batches(size: int, bits: int):
    """Sizes and signatures of all rows, then this task's counts of sets by shingle, in ``2**bits`` cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total, width = Hasher("lower"), np.zeros(1 << bits, np.uint32), (1 << bits) // SKETCH_PARTS
        names = [c.split()[0] for c in SETS.split(", ")]
        some = False
        for batch in batches:
            data, offsets, _ = text_buffers(batch.column("text"))
            seen: set = set()
            for i, j in pieces(offsets):
                s = Shingles(hasher, data, offsets[i : j + 1], size)
                a, b = s.signatures()
                fresh = np.zeros(j - i, bool)
                fresh[unseen(a, b, seen)] = True
                total += np.bincount(cells(s.values[fresh[s.rows]], bits), minlength=1 << bits).astype(np.uint32)
                some = True
                kept = [batch.column(c).slice(i, j - i) for c in ("doc_id", "text_key")]
                longs = [pa.array(c, pa.int64()) for c in (s.counts(), a.view(np.int64), b.view(np.int64))]
                yield pa.RecordBatch.from_arrays(kept + longs + [pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.binary())], names=names)
        if some:
            none = [pa.nulls(SKETCH_PARTS, pa.int64())] * 5
            packed = [planes(total[k * width : (k + 1) * width]) for k in range(SKETCH_PARTS)]
            yield pa.RecordBatch.from_arrays(none + [pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(packed, pa.binary())], names=names)
        returned()

    return run


def summed(key, table):
    """Steps of a quarter of a power of two, by cell, of one part of the counts."""
    total = 0
    for packed in table["counts"].to_pylist():
        total = total + unplanes(packed)
    steps = np.floor(4 * np.log2(1.0 + total)).astype(np.uint8)
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "steps": pa.array([steps.tobytes()], pa.binary())})


def prefixes(n: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """(index, probe): how many first shingles of a set of n can be the first that it shares.

    Linked sets share t of the larger one, and 2 t / (1 + t) of the smaller one
    at least.  So one of the ``index`` first shingles of the smaller set is among
    the ``probe`` first ones of the larger.  Both are 0 where only equal sets link.
    """
    p, q = t.numerator, t.denominator
    index = n - -(-2 * n * p // (p + q)) + 1
    probe = n - -(-n * p // q) + 1
    alone = n * (q - p) < p
    return np.where(alone, 0, index), np.where(alone, 0, probe)


def dims_of(n: np.ndarray) -> np.ndarray:
    return np.array(DIMS, np.int64)[np.searchsorted(np.array(DIM_SIZES, np.int64), n)]


def count_points(values: np.ndarray, rows: np.ndarray, dims: np.ndarray) -> np.ndarray:
    """Group counts of all rows, ``dims`` for each, one after another."""
    base = np.cumsum(dims) - dims
    group = (mix(values ^ np.uint64(0x7F4A7C15)) >> np.uint64(54)).astype(np.int64)  # 1024 groups; fewer ones are unions of these
    return np.bincount(base[rows] + group // (1024 // dims[rows]), minlength=int(dims.sum()))


def snug(values: np.ndarray) -> np.ndarray:
    """The same numbers in the fewest bytes."""
    most = int(values.max()) if values.size else 0
    return values.astype("<u1" if most < 256 else "<u2" if most < 65536 else "<u4")


def narrow(values: np.ndarray) -> bytes:
    values = snug(values)
    return bytes([values.itemsize]) + squeeze(values.tobytes())


def widened(packed: bytes) -> np.ndarray:
    return np.frombuffer(unsqueeze(packed[1:]), f"<u{packed[0]}")


def key_batches(size: int, t: Fraction, order, bits: int, hot: float, range_bits: int):
    """Posting lists: by range of keys, the shingles of all prefixes with the points of their sets.

    A shingle of more than ``hot`` sets gets no list that a single task would
    have to hold: ranges below 0 have edges from a node of its own to its sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, steps = Hasher("lower"), np.frombuffer(order.value, np.uint8)
        often = 4 * np.log2(1.0 + hot)
        names = [c.split()[0] for c in KEYS.split(", ")]
        kinds = [pa.int32()] + [pa.binary()] * 6
        for batch in batches:
            data, offsets, _ = text_buffers(batch.column("text"))
            found, seen, upto = [], set(), 0
            for i, j in pieces(offsets):
                s = Shingles(hasher, data, offsets[i : j + 1], size)
                a, b = s.signatures()
                n = s.counts()
                index, probe = prefixes(n, t)
                chosen = unseen(a, b, seen)
                chosen = chosen[probe[chosen] > 0]
                take = np.isin(s.rows, chosen)
                values, rows = s.values[take], np.searchsorted(chosen, s.rows[take])
                step = steps[cells(values, bits)]
                ranked = np.lexsort((values, step, rows))
                place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                first = place < probe[chosen][rows]
                ranked, row = ranked[first], rows[first]
                dims = dims_of(n[chosen])
                found.append((mix(values[ranked]), row + upto, place[first] < index[chosen][row], step[ranked] > often, a[chosen], n[chosen], dims, count_points(values, rows, dims)))
                upto += len(chosen)
            if not found:
                continue
            keys, docs, role, common, nodes, sizes, dims, points = (np.concatenate(x) for x in zip(*found, strict=True))
            base = np.cumsum(dims) - dims
            if common.any():
                u, v = forest(keys[common].view(np.int64), nodes[docs[common]].view(np.int64))
                spot = -1 - int(u.view(np.uint64).sum() % np.uint64(1024))  # any of many groups
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((spot, planes(u.view(np.uint64)), planes(v.view(np.uint64)), *[b""] * 4), kinds, strict=True)], names=names)
                keys, docs, role = keys[~common], docs[~common], role[~common]
            ranked = np.argsort(keys, kind="stable")
            keys, docs, role = keys[ranked], docs[ranked], role[ranked]
            top = (keys >> np.uint64(64 - range_bits)).astype(np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(top)) + 1, [len(top)]]) if len(top) else [0]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                used, at = np.unique(docs[x:y], return_inverse=True)
                own = used[np.argsort(dims[used], kind="stable")]  # sets of few groups first
                own = points[ragged(base[own], dims[own])]
                out = (int(top[x]), pack_sorted(keys[x:y]), planes(at), np.packbits(role[x:y]).tobytes(), planes(nodes[used]), planes(sizes[used]), narrow(own))
                yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(out, kinds, strict=True)], names=names)
        returned()

    return run


class CountTree:
    """R-tree over group counts, packed by halving along the widest coordinate."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.root = self._build(np.arange(len(points)))

    def _build(self, members: np.ndarray) -> dict:
        p, n = self.points[members], self.sizes[members]
        node = {"high": p.max(axis=0), "least": int(n.min()), "most": int(n.max()), "members": None, "children": ()}
        if len(members) <= LEAF:
            node["members"] = members
        else:
            axis = int((p.max(axis=0).astype(np.int64) - p.min(axis=0)).argmax())
            order = members[np.argsort(p[:, axis], kind="stable")]
            half = len(order) // 2
            node["children"] = (self._build(order[:half]), self._build(order[half:]))
        return node


def needed(a, b, t: Fraction):
    """Least overlap that two sizes need (as a real number)."""
    return (a + b) * t.numerator / (t.numerator + t.denominator)


def tree_pairs(x: dict, y: dict, t: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaf pairs of two trees (or of one with itself) that the bound on boxes leaves."""
    todo = [(x, y)]
    while todo:
        a, b = todo.pop()
        if a["most"] * t.denominator < b["least"] * t.numerator or b["most"] * t.denominator < a["least"] * t.numerator:
            continue
        if int(np.minimum(a["high"], b["high"]).sum(dtype=np.int64)) + 1e-6 < needed(a["least"], b["least"], t):
            continue
        if a["members"] is not None and b["members"] is not None:
            yield a["members"], b["members"]
        elif a is b:
            c, d = a["children"]
            todo += [(c, d), (c, c), (d, d)]
        elif b["members"] is not None or (a["members"] is None and len(a["children"]) and a["most"] - a["least"] >= b["most"] - b["least"]):
            todo += [(c, b) for c in a["children"]]
        else:
            todo += [(a, c) for c in b["children"]]


class Postings:
    """The posting lists of one range of keys, and what their points connect."""

    def __init__(self, table: pa.Table, t: Fraction):
        self.t = t
        keys, docs, role, nodes, sizes, n = [], [], [], [], [], 0
        points: dict = {d: ([], [np.zeros((0, d), np.uint8)]) for d in DIMS}  # by groups: numbers of sets, their points
        for k in range(table.num_rows):
            row = {c: table[c][k].as_py() for c in table.column_names}
            keys.append(unpack_sorted(row["keys"]))
            docs.append(unplanes(row["doc"]).astype(np.int32) + np.int32(n))
            role.append(np.unpackbits(np.frombuffer(row["role"], np.uint8), count=len(keys[-1])).astype(bool))
            nodes.append(unplanes(row["nodes"]))
            sizes.append(unplanes(row["sizes"]).astype(np.int64))
            flat, upto, dims = widened(row["points"]), 0, dims_of(sizes[-1])
            for d in DIMS:
                mine = np.flatnonzero(dims == d)
                points[d][0].append(mine + n)
                points[d][1].append(flat[upto : upto + len(mine) * d].reshape(-1, d))
                upto += len(mine) * d
            n += len(nodes[-1])
        keys, docs, role, nodes, sizes = (np.concatenate(x) for x in (keys, docs, role, nodes, sizes))
        self.nodes, kept, at = np.unique(nodes, return_index=True, return_inverse=True)
        self.sizes, docs = sizes[kept], at[docs]
        self.dims = dims_of(self.sizes)
        wide = {}
        for d in DIMS:
            number = np.concatenate(points[d][0])
            first = kept[self.dims == d]
            wide[d] = np.concatenate(points[d][1])[np.searchsorted(number, first)]
            points[d] = None
        self.points = {}  # by groups: (row of the matrix for each node, matrix)
        for d in DIMS:  # points of more groups are folded to fewer, too
            at = np.full(len(self.nodes), -1, np.int32)
            folded = [snug(wide[w].reshape(-1, d, w // d).sum(axis=2, dtype=np.uint32)) if w > d else wide[w] for w in DIMS if w >= d]
            at[np.concatenate([np.flatnonzero(self.dims == w) for w in DIMS if w >= d])] = np.arange(sum(map(len, folded)), dtype=np.int32)
            self.points[d] = at, np.concatenate(folded)
        # a list has every set once, those that may be the smaller one first
        ranked = np.lexsort((docs, ~role, keys))
        keys, docs, role = keys[ranked], docs[ranked], role[ranked]
        same = np.lexsort((~role, docs, keys))
        fresh = np.ones(len(keys), bool)
        fresh[same[1:]] = (keys[same[1:]] != keys[same[:-1]]) | (docs[same[1:]] != docs[same[:-1]])
        keys, docs, role = keys[fresh], docs[fresh], role[fresh]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        length = np.diff(np.append(first, len(keys)))
        good = (length > 1) & role[first]
        self.first, self.length, self.docs, self.role = first[good], length[good], docs, role
        self.label = np.arange(len(self.nodes))

    def near(self, u: np.ndarray, v: np.ndarray, most: int = 1 << 16) -> np.ndarray:
        """Pairs that sizes and the bound on the overlap leave."""
        a, b = np.minimum(self.sizes[u], self.sizes[v]), np.maximum(self.sizes[u], self.sizes[v])
        out = a * self.t.denominator >= b * self.t.numerator
        dims = np.minimum(self.dims[u], self.dims[v])
        for d, (place, matrix) in self.points.items():
            which = np.flatnonzero(out & (dims == d))
            for i in range(0, len(which), most * DIMS[0] // d):
                w = which[i : i + most * DIMS[0] // d]
                bound = np.minimum(matrix[place[u[w]]], matrix[place[v[w]]]).sum(axis=1, dtype=np.int64)
                out[w] = bound + 1e-6 >= needed(a[w], b[w], self.t)
        return out

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        apart = self.label[u] != self.label[v]
        pairs = np.unique(np.minimum(u, v)[apart] * len(self.nodes) + np.maximum(u, v)[apart])
        u, v = pairs // max(1, len(self.nodes)), pairs % max(1, len(self.nodes))
        ok = self.near(u, v)
        self.label = joined(u[ok], v[ok], self.label)

    def split(self) -> tuple[np.ndarray, np.ndarray]:
        """Lists whose sets are not yet all connected: (first, length)."""
        label = self.label[self.docs]
        least = np.minimum.reduceat(label, self.first) if len(self.first) else label[:0]
        inside = ragged(self.first, self.length)
        many = np.add.reduceat((label[inside] != np.repeat(least, self.length)).astype(np.int64), np.cumsum(self.length) - self.length) if len(inside) else least
        return self.first[many > 0], self.length[many > 0]

    def connect(self, pivots: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """(least node, node) edges that connect what the bound connects inside any list."""
        first, length = self.first, self.length
        for k in range(pivots):  # lists against their first set, then against one that is still apart
            if not len(first):
                break
            inside = ragged(first, length)
            if k:
                label = self.label[self.docs[inside]]
                begin = np.cumsum(length) - length
                apart = label != np.repeat(self.label[self.docs[first]], length)
                hashed = np.where(apart, mix((self.docs[inside] + k * 0x9E3779B9).astype(np.uint64)) >> np.uint64(2), np.uint64(1) << np.uint64(63))
                low = np.minimum.reduceat(hashed, begin)
                spot = np.flatnonzero(hashed == np.repeat(low, length))
                _, one = np.unique(np.repeat(np.arange(len(first)), length)[spot], return_index=True)
                centre = self.docs[inside][spot[one]]
            else:
                centre = self.docs[first]
            self.join(np.repeat(centre, length), self.docs[inside])
            first, length = self.split()
        small = length <= LEAF
        some, upto = np.flatnonzero(small), 0
        while upto < len(some):  # a short list is a single leaf
            cost = np.cumsum(length[some[upto:]] ** 2)
            part = some[upto : upto + max(1, int(np.searchsorted(cost, 1 << 22)))]
            upto += len(part)
            at, n = first[part], length[part]
            one = ragged(at, n)
            left = np.repeat(one, np.repeat(n, n))
            right = ragged(np.repeat(at, n), np.repeat(n, n))
            ok = (left < right) & (self.role[left] | self.role[right])
            self.join(self.docs[left[ok]], self.docs[right[ok]])
        place, matrix = self.points[DIMS[0]]
        for at, n in zip(first[~small], length[~small], strict=True):
            docs, role = self.docs[at : at + n], self.role[at : at + n]
            tree = CountTree(matrix[place[docs]], self.sizes[docs])
            todo_u, todo_v, held = [], [], 0
            for left, right in tree_pairs(tree.root, tree.root, self.t):
                i, j = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
                ok = (role[i] | role[j]) & (self.label[docs[i]] != self.label[docs[j]])
                todo_u.append(docs[i[ok]])
                todo_v.append(docs[j[ok]])
                held += int(ok.sum())
                if held > 1 << 18:
                    self.join(np.concatenate(todo_u), np.concatenate(todo_v))
                    todo_u, todo_v, held = [], [], 0
            if held:
                self.join(np.concatenate(todo_u), np.concatenate(todo_v))
        other = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.nodes[self.label[other]], self.nodes[other]


def connector(num: int, den: int):
    t = Fraction(num, den)

    def run(key, table):
        if key[0].as_py() < 0:
            a, b = (np.concatenate([unplanes(x) for x in table[c].to_pylist()]) for c in ("keys", "doc"))
        else:
            a, b = Postings(table, t).connect()
        returned()
        return pa.table({"a": pa.array(a.view(np.int64), pa.int64()), "b": pa.array(b.view(np.int64), pa.int64())})

    return run


def link(sets: list[np.ndarray], side: np.ndarray, label: np.ndarray, t: Fraction) -> list[tuple[int, int]]:
    """Verified links that join all members linked by any (a forest).

    Members of one ``label`` are joined already.  With two sides only pairs
    across them count.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    dims = DIMS[0] if np.median(sizes) <= DIM_SIZES[0] else DIMS[1]
    rows = np.repeat(np.arange(len(sets)), sizes)
    points = count_points(np.concatenate(sets), rows, np.full(len(sets), dims)).reshape(-1, dims).astype(np.uint32)
    label, found = np.unique(label, return_inverse=True)[1], []
    parts = [np.flatnonzero(side == s) for s in np.unique(side)]
    trees = [CountTree(points[p], sizes[p]) for p in parts]
    for left, right in tree_pairs(trees[0].root, trees[-1].root, t):
        a, b = parts[0][left], parts[-1][right]
        if (label[a] == label[a[0]]).all() and (label[b] == label[a[0]]).all():
            continue
        bound = np.minimum(points[a][:, None, :], points[b][None, :, :]).sum(axis=2, dtype=np.int64)
        i, j = np.nonzero(bound + 1e-6 >= needed(sizes[a][:, None], sizes[b][None, :], t))
        order = np.argsort(-bound[i, j], kind="stable")
        p, q = a[i[order]], b[j[order]]
        while len(p):
            p, q = p[label[p] != label[q]], q[label[p] != label[q]]
            hits, k = 0, -1
            for k in range(len(p)):
                u, v = int(p[k]), int(q[k])
                if label[u] == label[v]:
                    continue
                both = len(np.intersect1d(sets[u], sets[v], assume_unique=True))
                if t.denominator * both >= t.numerator * (len(sets[u]) + len(sets[v]) - both):
                    found.append((u, v))
                    label[label == label[v]] = label[u]
                    hits += 1
                    if hits == 64:  # drop what the new links have joined
                        break
            p, q = p[k + 1 :], q[k + 1 :]
    return found


def linker(num: int, den: int):
    t = Fraction(num, den)

    def run(key, table):
        ids = np.asarray(table["node"].combine_chunks())
        side, label = (np.asarray(table[c].combine_chunks()) for c in ("side", "label"))
        _, first = np.unique(np.stack([ids, side]), axis=1, return_index=True)  # copies of a set count once
        ids, side, label = ids[first], side[first], label[first]
        sets = [unpack_sorted(x) for x in table["shingles"].take(pa.array(first)).to_pylist()]
        found = link(sets, side, label, t) if len(sets) > 1 else []
        return pa.table({"a": pa.array([ids[u] for u, _ in found], pa.int64()), "b": pa.array([ids[v] for _, v in found], pa.int64())})

    return run


def cluster_links(points: DataFrame, t: Fraction, block_members: int, block_bytes: int = 16 << 20, pivots: int = 8) -> DataFrame:
    """Links (a, b) that join what is linked inside each cluster of ``points`` (cluster, node, shingles).

    A cluster of up to ``block_members`` sets and ``block_bytes`` is one group.
    A larger one is joined inside its blocks first, then through some ``pivots``
    of each part so far; what has come together needs no more tests.  Only
    points outside the cluster's largest part are then held against every block,
    so that a large group of like texts costs what its size costs, and no pair
    is left out.
    """
    run = lambda df: df.groupBy("cluster", "left", "right").applyInArrow(linker(t.numerator, t.denominator), EDGES)
    zero = F.lit(0).cast("long")
    parts = F.ceil(F.greatest(F.count("*") / block_members, F.sum(F.octet_length("shingles")) / block_bytes)).cast("long")
    blocks = saved(points.groupBy("cluster").agg(parts.alias("blocks")).filter("blocks > 1"), "blocks")
    dealt = points.join(blocks, "cluster", "left").withColumn("left", F.coalesce(F.pmod(F.xxhash64("node"), F.col("blocks")), zero))
    links = saved(run(dealt.select("cluster", "left", zero.alias("right"), zero.alias("side"), F.col("node").alias("label"), "node", "shingles")), "links")
    if blocks.isEmpty():
        return links
    large = saved(dealt.filter("blocks > 1").dropDuplicates(["cluster", "node"]), "large-clusters")

    def labelled(known: DataFrame) -> DataFrame:
        named = saved(components(known).select("node", "component"), "parts")
        return large.join(named, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")

    heads = labelled(links).groupBy("cluster", "label", F.pmod(F.xxhash64("node"), F.lit(pivots)).alias("slot"))
    heads = heads.agg(F.min_by(F.struct("node", "shingles"), "node").alias("head")).select("cluster", "label", "head.*")
    heads = saved(heads, "heads")
    wide = heads.groupBy("cluster").agg(parts.alias("wide"))
    dealt = heads.join(wide, "cluster").withColumn("left", F.pmod(F.xxhash64("label"), F.col("wide")))
    links = saved(links.unionByName(run(dealt.select("cluster", "left", zero.alias("right"), zero.alias("side"), "label", "node", "shingles"))), "links")

    now = saved(labelled(links), "labelled")
    main = now.groupBy("cluster", "label").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    apart = saved(now.join(main, "cluster").filter("label <> main").drop("main"), "apart")
    slices = saved(apart.groupBy("cluster").agg(parts.alias("slices")), "slices")
    upto = lambda c: F.explode(F.sequence(zero, F.col(c) - 1))
    columns = ["cluster", "left", "right", "side", "label", "node", "shingles"]
    one = now.join(slices, "cluster").withColumn("right", upto("slices")).withColumn("side", zero)
    two = apart.join(slices, "cluster").withColumn("right", F.pmod(F.xxhash64("node"), F.col("slices"))).withColumn("left", upto("blocks")).withColumn("side", F.lit(1).cast("long"))
    return links.unionByName(run(one.select(*columns).unionByName(two.select(*columns))))


def point_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher("lower")
        for batch in batches:
            data, offsets, _ = text_buffers(batch.column("text"))
            seen: set = set()
            for i, j in pieces(offsets):
                s = Shingles(hasher, data, offsets[i : j + 1], size)
                a, b = s.signatures()
                fresh = unseen(a, b, seen)
                blobs = [pack_sorted(s.values[s.at[k] : s.at[k + 1]]) for k in fresh]
                cluster = batch.column("cluster").slice(i, j - i).take(pa.array(fresh))
                yield pa.RecordBatch.from_arrays([cluster, pa.array(a[fresh].view(np.int64), pa.int64()), pa.array(blobs, pa.binary())], names=["cluster", "node", "shingles"])
        returned()

    return run


def candidate_edges(rows: DataFrame, sets: DataFrame, size: int, t: Fraction, sketch_bits: int, range_bits: int, hot_sets: int) -> DataFrame:
    """Edges (a, b) between nodes that connect all pairs which may be linked.

    Shingles are ordered by counts in ``2**sketch_bits`` cells (as many bytes are
    broadcast).  The order decides the work, not the result.
    """
    spark = rows.sparkSession
    counted = sets.filter("part is not null").select("part", "counts").groupBy("part").applyInArrow(summed, "part int, steps binary")
    steps = b"".join(bytes(r["steps"]) for r in counted.orderBy("part").collect()) or bytes(1 << sketch_bits)
    average = float(np.mean(2.0 ** (np.frombuffer(steps, np.uint8) / 4)))
    run = key_batches(size, t, spark.sparkContext.broadcast(steps), sketch_bits, max(hot_sets, 8 * average), range_bits)
    return rows.select("text").mapInArrow(run, KEYS).groupBy("range").applyInArrow(connector(t.numerator, t.denominator), EDGES)


def jaccard_components(
    docs: DataFrame,
    size: int = 5,
    threshold: tuple[int, int] = (4, 5),
    block_members: int = 4096,
    range_bytes: int = 64 << 20,
    hot_sets: int = 1 << 22,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Words are cut at white space, A-Z lower-cased; a set holds the distinct
    shingles of ``size`` words, or the whole of a shorter text.  Documents whose
    sets have a Jaccard similarity of ``threshold`` (as a fraction) or more are
    linked; a component is named by its least doc_id.  A document without words
    (or a null text) has an empty set and no links.  Rows that share a doc_id
    and have words are one document, hence linked.  A row without a doc_id is
    linked by its text like any other; a component of only such rows has a null
    component_id.  An empty table gives none; other columns of ``docs`` are not
    read.  Shingles are known by 64-bit hashes, sets by two of them.  For large
    clusters see :func:`cluster_links`; a shingle that stands in the prefixes of
    more than ``hot_sets`` sets connects them without a look at their points.
    """
    t = Fraction(*threshold)
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    total = text_bytes(rows)
    sketch_bits = max(20, min(24, (total >> 9).bit_length()))
    range_bits = max(4, min(20, (total // range_bytes).bit_length()))
    both = saved(rows.mapInArrow(set_batches(size, sketch_bits), SETS), "shingle-sets")
    sets = both.filter("part is null").select("doc_id", "text_key", "n_shingles", "sig_a", "sig_b")
    filled = sets.filter("n_shingles > 0")

    edges = saved(candidate_edges(rows, both, size, t, sketch_bits, range_bits, hot_sets), "candidates")
    clusters = saved(components(edges).select("node", F.col("component").alias("cluster")), "clusters")

    # one row of each node in a cluster brings its text; the texts are dealt out
    # at any size, so that the plan does not turn on a table's size
    rid = F.coalesce("doc_id", "text_key").alias("rid")
    chosen = filled.select(F.col("sig_a").alias("node"), F.struct(rid, "text_key").alias("row")).join(clusters, "node")
    chosen = saved(chosen.groupBy("node", "cluster").agg(F.min("row").alias("row")).select("cluster", "row.*"), "cluster-rows")
    wanted = rows.withColumn("rid", rid).join(chosen.hint("shuffle_hash"), ["rid", "text_key"]).select("cluster", "text")
    points = saved(wanted.mapInArrow(point_batches(size), POINTS), "points")
    links = cluster_links(points, t, block_members)

    # several sets of one doc_id
    named = filled.filter("doc_id is not null")
    several = saved(named.groupBy("doc_id").agg(F.min("sig_a").alias("a"), F.max("sig_a").alias("most")).filter("a <> most"), "several-sets")
    links = links.unionByName(named.join(several, "doc_id").filter("sig_a <> a").select("a", F.col("sig_a").alias("b")).distinct())

    found = saved(components(links).select("node", "component"), "components")
    own = filled.join(found, F.col("sig_a") == F.col("node"), "left")
    own = own.select("doc_id", "n_shingles", F.coalesce("component", "sig_a").alias("part"), F.when(F.col("component").isNull(), F.col("sig_b")).alias("part_b"))
    own = saved(own.withColumn("part_b", F.coalesce("part_b", F.lit(0).cast("long"))), "named-sets")
    least = saved(own.groupBy("part", "part_b").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows")).filter("rows > 1").drop("rows"), "least-ids")
    out = own.join(least, ["part", "part_b"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    empty = sets.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(empty)
