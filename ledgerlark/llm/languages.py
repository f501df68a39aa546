"""Language ID by cross-parsing entropy.

For each language, a suffix automaton of labelled text.  A text is parsed
greedily into the longest phrases that occur in the training text; the language
that needs the fewest phrases for its length is the nearest (Ziv-Merhav
cross-parsing).  Texts are parsed in blocks of ``block`` letters, all blocks of
a batch in step, so that a step is a few array operations; a block's last phrase
ends with it.  Every letter of every text is parsed.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shipped
from .kernels import text_buffers


def letter_table() -> np.ndarray:
    """Code point -> its lower-cased letter, or 32 for all that are no letters."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters_of(code_points: np.ndarray, rows: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points with runs of other characters as one blank, and their rows."""
    folded = table[np.minimum(code_points, 0x10FFFF)]
    blank = folded == 32
    keep = np.ones(len(folded), bool)
    keep[1:] = ~(blank[1:] & blank[:-1] & (rows[1:] == rows[:-1]))
    return folded[keep], rows[keep]


def suffix_automaton(symbols: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transitions of the automaton of all substrings.

    Those of symbols below ``alphabet`` as [state, symbol], -1 where there is
    none; the others as sorted keys (state << 32 | symbol) and their states.
    """
    n = len(symbols)
    go = np.full((max(2, 2 * n), alphabet), -1, np.int32)
    rare: dict[int, dict[int, int]] = {}
    get = lambda p, c: int(go[p, c]) if c < alphabet else rare.get(p, {}).get(c, -1)

    def put(p: int, c: int, to: int) -> None:
        if c < alphabet:
            go[p, c] = to
        else:
            rare.setdefault(p, {})[c] = to

    link, length = [-1], [0]
    last = 0
    for c in symbols.tolist():
        cur = len(link)
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and get(p, c) < 0:
            put(p, c, cur)
            p = link[p]
        if p >= 0:
            q = get(p, c)
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                go[copy] = go[q]
                if q in rare:
                    rare[copy] = dict(rare[q])
                while p >= 0 and get(p, c) == q:
                    put(p, c, copy)
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    sparse = sorted((p << 32 | c, to) for p, of in rare.items() for c, to in of.items())
    return go[: len(link)].copy(), np.array([k for k, _ in sparse], np.int64), np.array([t for _, t in sparse], np.int32)


@dataclass
class Languages:
    names: list[str]
    symbol: dict[int, int]  # letter -> symbol; 0 is any other
    tables: list[np.ndarray]  # transitions [state, symbol] by language, flattened; state 0 is the start
    sparse: list[tuple[np.ndarray, np.ndarray]]  # keys and states of the transitions of symbols from ``alphabet`` on
    alphabet: int
    letters: np.ndarray

    def phrases(self, texts: pa.Array, block: int, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases [row, language], letters parsed, has a letter) of each text."""
        n = len(texts)
        counts, sizes, lettered = np.zeros((n, len(self.names))), np.zeros(n), np.zeros(n, bool)
        to_symbol = self.symbols()
        data, offsets, _ = text_buffers(texts)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
            raw = data[offsets[i] : offsets[j]]
            points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
            lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            rows = np.repeat(np.arange(i, j), np.diff(lead[offsets[i : j + 1] - offsets[i]]))
            folded, rows = letters_of(points, rows, self.letters)
            lettered[rows[folded != 32]] = True
            sizes += np.bincount(rows, minlength=n)
            self._parse(to_symbol[folded], rows, block, counts)
            i = j
        return counts, sizes, lettered

    def symbols(self) -> np.ndarray:
        """Letter -> its symbol, 0 if unknown; made once in a process."""
        if not hasattr(self, "_symbols"):
            self._symbols = np.zeros(0x110000, np.uint32)
            for c, s in self.symbol.items():
                self._symbols[c] = s
        return self._symbols

    def _step(self, k: int, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Where symbols lead in language ``k``, or -1."""
        table, (keys, states) = self.tables[k], self.sparse[k]
        if len(self.symbol) < self.alphabet:
            return table[state * self.alphabet + c]
        common = c < self.alphabet
        to = table[state * self.alphabet + np.where(common, c, 0)]
        i = np.flatnonzero(~common)
        if len(i) and len(keys):
            want = (state[i].astype(np.int64) << 32) | c[i].astype(np.int64)
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            to[i] = np.where(keys[at] == want, states[at], -1)
        return to

    def _parse(self, symbols: np.ndarray, rows: np.ndarray, block: int, counts: np.ndarray) -> None:
        if not len(symbols):
            return
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        size = np.diff(np.append(first, len(rows)))
        per_row = -(-size // block)
        start = np.repeat(first, per_row) + (np.arange(int(per_row.sum())) - np.repeat(np.cumsum(per_row) - per_row, per_row)) * block
        stop = np.minimum(start + block, np.repeat(first + size, per_row))
        order = np.argsort(start - stop, kind="stable")
        start, left = start[order], (stop - start)[order]
        of_row = rows[start]
        active = np.searchsorted(-left, -np.arange(block), "left")  # blocks longer than each step
        for k in range(len(self.tables)):
            state, phrases = np.zeros(len(start), np.int32), np.zeros(len(start), np.int32)
            for step in range(int(left[0])):
                m = active[step]
                c = symbols[start[:m] + step]
                to = self._step(k, state[:m], c)
                ended = to < 0
                # a phrase starts with this letter: at the start, after a letter that the
                # language lacks (a phrase of its own), or where the last one cannot go on
                phrases[:m] += ended | (state[:m] == 0)
                state[:m] = np.maximum(np.where(ended, self._step(k, np.zeros(m, np.int32), c), to), 0)
            counts[:, k] += np.bincount(of_row, phrases, minlength=len(counts))


def train(docs: DataFrame, learn: Column, letters_per_language: int = 20_000, most_letters: int = 400_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Languages:
    """Automata from a bounded sample of labelled rows for which ``learn`` holds.

    A language is learnt from its rows of least xxhash64(doc_id), up to
    ``letters_per_language`` letters, or fewer so that all languages together
    stay within ``most_letters``.  Every letter of the sample is a symbol; the
    255 most frequent ones have dense transitions, the others sparse ones.
    """
    known = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    budget = max(200, min(letters_per_language, most_letters // max(1, known.select(lang_col).distinct().count())))
    usable = F.least(F.length(text_col), F.lit(budget))
    totals = known.groupBy(lang_col).agg(F.sum(usable).alias("chars")).orderBy(lang_col).collect()
    share = {r[lang_col]: min(1.0, (4.0 * budget + 100_000) / max(1, r["chars"])) for r in totals}  # about four times the letters needed
    hashed = known.withColumn("hash", F.xxhash64(id_col))
    table, texts = letter_table(), {k: [] for k in share}
    short = list(share)
    while short:
        bound = F.lit((1 << 63) - 1)
        for k in short:
            if share[k] < 1:
                bound = F.when(F.col(lang_col) == k, F.lit(int(-(1 << 63) + (1 << 64) * share[k]))).otherwise(bound)
        sample = hashed.filter(F.col(lang_col).isin(short) & (F.col("hash") <= bound))
        have = dict.fromkeys(short, 0)
        texts |= {k: [] for k in short}
        for r in sample.select(lang_col, "hash", F.substring(text_col, 1, budget).alias("text")).orderBy(lang_col, "hash", "text").collect():
            k = r[lang_col]
            if have[k] < budget:
                points = np.frombuffer((" " + r["text"]).encode("utf-32-le", "surrogatepass"), np.uint32)
                folded, _ = letters_of(points, np.zeros(len(points), np.int64), table)
                texts[k].append(folded[: budget - have[k]])
                have[k] += len(texts[k][-1])
        short = [k for k in short if have[k] < budget and share[k] < 1]  # too few letters: more rows, again of least hash
        share |= {k: min(1.0, share[k] * 8) for k in short}
    joined = {k: np.concatenate(v) if v else np.zeros(0, np.uint32) for k, v in texts.items()}
    seen, count = np.unique(np.concatenate([*joined.values(), np.array([32], np.uint32)]), return_counts=True)
    ranked = seen[np.argsort(-count, kind="stable")]
    symbol = {int(c): s + 1 for s, c in enumerate([*np.sort(ranked[:255]), *ranked[255:]])}
    alphabet, tables, sparse = min(len(symbol), 255) + 1, [], []
    for text in joined.values():
        go, *others = suffix_automaton(np.array([symbol[int(c)] for c in text], np.int64), alphabet)
        go[:, 0] = -1  # the symbol of unknown letters matches nothing
        tables.append(go.ravel())
        sparse.append(tuple(others))
    return Languages(list(joined), symbol, tables, sparse, alphabet, table)


def identify(docs: DataFrame, model: Languages, block: int = 512, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score.

    ``und`` with score 0 for a null text, one without a letter, or without any
    language learnt.  The score is the margin: 1 less the winner's phrases over
    those of the second (1 where there is one language).  Ties go to the first
    language by name.
    """
    shared = shipped(docs.sparkSession, model)

    @F.arrow_udf("struct<lang_pred string, score double>")
    def named(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = pickle.loads(shared.value)
        n = len(model.names)
        for text in texts:
            lang, score = np.full(len(text), "und", object), np.zeros(len(text))
            if n and len(text):
                counts, _, lettered = model.phrases(text, block)
                ranked = np.sort(counts, axis=1)
                margin = 1 - ranked[:, 0] / np.maximum(ranked[:, 1], 1) if n > 1 else np.ones(len(text))
                lang[lettered] = np.array(model.names, object)[counts.argmin(axis=1)][lettered]
                score[lettered] = margin[lettered]
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], names=["lang_pred", "score"])

    return docs.withColumn("__named", named(F.col(text_col))).withColumns({"lang_pred": F.col("__named.lang_pred"), "score": F.col("__named.score")}).drop("__named")
