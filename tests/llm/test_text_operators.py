"""Operators over texts against brute-force versions, with nulls, ties, repeats and clashing columns."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import ngrams, phrases, substrings

PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, key int, cluster int, rep int, kept int, item string, words string"


def words(seed, n, vocabulary=400):
    x, out = seed, []
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(f"w{(x >> 33) % vocabulary}")
    return out


def corpus():
    base = words(1, 200)
    texts = [
        " ".join(base),
        " ".join(base),
        " ".join(base[:100] + ["changed"] + base[101:]),
        " ".join(words(2, 50) + base[40:90] + words(3, 30)),
        " ".join(words(4, 25) * 3),
        "Ünïcode ß text\twith\nbreaks  " + " ".join(base[5:30]),
        " ".join(words(9, 20)),
        " ".join(words(9, 20)),
        " ".join(words(9, 19)),
        "a b",
        "a b",
        "one",
        "",
        None,
        " \t\n ",
        "rep " * 100,
        " ".join(words(7, 3000)),
        "NUL\x00byte " + " ".join(base[:25]),
        " ".join(base).upper(),
    ]
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", 1, 2, 3, 4, "y", "z") for i, t in rows], SCHEMA)


def brute_substrings(rows, size=20):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] if r[0] is not None else -1 << 63, r[1] or "")):
        w = PLAIN.findall(t or "")
        covered = [False] * len(w)
        for s in range(len(w) - size + 1):
            key = tuple(w[s : s + size])
            if key in seen:
                covered[s : s + size] = [True] * size
            seen.add(key)
        kept = " ".join(x for x, c in zip(w, covered, strict=True) if not c)
        out.append((i, len(w), sum(covered), kept, covered))
    return out


@pytest.mark.parametrize("chunk_bytes", [1 << 23, 1500])
def test_substrings(spark, chunk_bytes):
    rows = corpus()
    got = substrings.dedup_substrings(frame(spark, rows), chunk_bytes=chunk_bytes, range_windows=100).collect()
    want = brute_substrings(rows)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == sorted(w[:4] for w in want)
    covered = {w[0]: w[4] for w in want}
    for r in got:
        assert [any(s.start <= k < s.end for s in r.removed) for k in range(r.n_words)] == covered[r.doc_id]


def test_substrings_repeated_rows_and_null_ids(spark):
    text = " ".join(words(5, 40))
    rows = [(7, text), (7, text), (None, text), (3, "short")]
    got = substrings.dedup_substrings(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("3", 0), ("7", 40), ("7", 40), ("None", 0)]


def test_substrings_empty_table(spark):
    assert substrings.dedup_substrings(frame(spark, corpus()).limit(0)).count() == 0


def brute_components(rows, size, num, den):
    sets, parent = {}, {}
    for i, t in rows:
        w = PLAIN.findall((t or "").translate(LOW))
        sets[i] = {tuple(w[s : s + size]) for s in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return sorted((i, len(sets[i]), root(i)) for i in ids)


@pytest.mark.parametrize(("size", "num", "den"), [(3, 9, 10), (5, 4, 5), (1, 1, 2)])
def test_jaccard(spark, size, num, den):
    rows = corpus()
    base = words(11, 120)
    for k in range(12):  # a chain of near copies, and copies that miss the threshold
        rows.append((1000 - k, " ".join(base[:10] + [f"n{j}" for j in range(k)] + base[10 + k :])))
    for n in range(3, 14):
        rows.append((2000 + n, " ".join(words(21, n))))
    got = ngrams.jaccard_components(frame(spark, rows), size=size, threshold=(num, den), block_members=3)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows, size, num, den)


def test_large_clusters_lose_no_link(spark):
    """A cluster in many blocks: two dense groups, a bridge between them, and points on their own."""
    base, rows = words(31, 300), []
    for k in range(40):
        rows.append((k, " ".join(base[: 250 + k % 5])))
    far = base[:160] + words(33, 100)
    for k in range(25):
        rows.append((100 + k, " ".join(far[: 250 + k % 7])))
    rows += [(200, " ".join(base[:205] + words(33, 100)[45:])), (201, " ".join(base[:120]))]
    got = ngrams.jaccard_components(frame(spark, rows), size=2, threshold=(7, 10), block_members=4)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows, 2, 7, 10)


def test_jaccard_edge_tables(spark):
    assert ngrams.jaccard_components(frame(spark, corpus()).limit(0)).count() == 0
    got = ngrams.jaccard_components(frame(spark, [(4, "x y z"), (4, "x y z"), (None, None), (2, "")])).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == [("2", 0, "2"), ("4", 1, "4"), ("4", 1, "4"), ("None", 0, "None")]


def test_prefixes_of_linked_sets_meet():
    import numpy as np
    from fractions import Fraction

    rng = np.random.default_rng(3)
    for t in (Fraction(9, 10), Fraction(4, 5), Fraction(1, 2), Fraction(7, 10)):
        for _ in range(3000):
            a = int(rng.integers(1, 60))
            b = int(rng.integers(a, int(a / t) + 1))
            both = int(rng.integers(0, a + 1))
            if both < t * (a + b - both) or (both == a == b):
                continue
            tokens = rng.permutation(a + b - both)
            x, y = np.sort(tokens[:a]), np.sort(tokens[a - both :])
            (index, _), (_, probe) = (ngrams.prefixes(np.array([n]), t) for n in (a, b))
            assert np.intersect1d(x[: index[0]], y[: probe[0]]).size


def test_count_tree_prunes_only_what_cannot_link():
    import numpy as np
    from fractions import Fraction

    rng = np.random.default_rng(0)
    base = [np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64)) for _ in range(6)]
    sets = [np.unique(np.concatenate([b[:-k] if k else b, rng.integers(0, 1 << 63, k, dtype=np.uint64)])) for b in base for k in range(20)]
    found = ngrams.link(sets, np.zeros(len(sets), np.int64), np.arange(len(sets)), Fraction(9, 10))
    label = list(range(len(sets)))
    for u, v in found:
        label = [label[u] if x == label[v] else x for x in label]
    for u in range(len(sets)):
        for v in range(u):
            both = len(np.intersect1d(sets[u], sets[v]))
            if 10 * both >= 9 * (len(sets[u]) + len(sets[v]) - both):
                assert label[u] == label[v]


def brute_phrases(rows, items, size=10):
    windows, lengths = defaultdict(set), set()
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOW))
        n = min(size, len(w))
        if n:
            lengths.add(n)
            for s in range(len(w) - n + 1):
                windows[tuple(w[s : s + n])].add(str(i))
    out = []
    for i, t in rows:
        w = ALNUM.findall((t or "").translate(LOW))
        hit, names = set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                found = windows.get(tuple(w[s : s + n]))
                if found:
                    hit.update(range(s, s + n))
                    names |= found
        out.append((i, len(w), len(hit), sorted(names), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 25, 200])
def test_phrases(spark, block_bytes):
    rows = corpus()
    items = [(0, " ".join(words(1, 30))), (1, "A B"), (2, None), (3, ""), (10, "one"), (11, " ".join(words(3, 12))), (12, "Ünïcode ß-text"), (12, "with"), (13, "rep rep rep")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = phrases.decontaminate(frame(spark, rows), bench, segment_bytes=2000, block_bytes=block_bytes).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got], key=str) == brute_phrases(rows, items)


def test_phrases_without_items_or_documents(spark):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert phrases.decontaminate(frame(spark, corpus()).limit(0), bench).count() == 0
    assert phrases.decontaminate(frame(spark, corpus()), bench.limit(0)).filter("contaminated").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta"), (2, "alpha " + "x " * 20 + "beta"), (3, "beta alpha"), (4, "alpha")], "doc_id long, text string")
    query = spark.createDataFrame([("q", "alpha beta")], "item_id string, text string")
    index = phrases.build_index(docs)
    near = phrases.search(index, query, within=5).filter(F.size("hits") > 0)
    assert sorted(r.doc_id for r in near.collect()) == [1, 3]


def test_hashes_are_those_of_whole_words():
    import numpy as np
    import pyarrow as pa

    from ledgerlark.llm.kernels import Hasher, text_buffers

    hasher = Hasher("plain")
    data, offsets, _ = text_buffers(pa.array(["ab", "a b", None, "ab ab c"]))
    w = hasher.words(data, offsets)
    h = w.hashes()
    assert w.counts().tolist() == [1, 2, 0, 3]
    assert h[0] == h[3] and len(set(h.tolist())) == 4
    sliced, at, _ = text_buffers(pa.array(["zz", "a b", "ab"]).slice(1))
    assert np.array_equal(hasher.words(sliced, at).hashes(), np.array([h[1], h[2], h[0]]))
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
