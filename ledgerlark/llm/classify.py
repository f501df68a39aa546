"""Toxicity: a linear classifier regularised by counterfactuals.

A document is the set of its words and their leading bytes, hashed.  Logistic
regression on labelled rows gets a second penalty: for every labelled sentence
with an identity term, the term is swapped for others and the squared change of
the sentence's logit is added, so that naming a group does not move a score.
Scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codecs import planes, unplanes
from .common import saved, shipped
from .kernels import Hasher, Words, mix, pieces, returned, text_buffers

#: Groups of identity terms of one language; a term is swapped for the others of its group.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "homosexual", "heterosexual", "transgender"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("frau", "mann"),
    ("schwul", "lesbisch"),
    ("femmes", "hommes", "filles", "garçons"),
    ("femme", "homme", "fille", "garçon"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("mujer", "hombre", "chica", "chico"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("immigrant", "native", "foreigner", "refugee", "migrant"),
    ("immigrants", "natives", "foreigners", "refugees", "migrants"),
    ("old", "young", "elderly"),
    ("deaf", "blind", "disabled", "autistic"),
)

LEADS = (3, 4, 5, 6)
#: Leading bits of a feature that are looked up before the feature itself.
SIEVE_BITS = 20


def features(words: Words) -> np.ndarray:
    """uint64 (words, 1 + leads): the word, and its leading bytes (0 where the word is no longer)."""
    whole = words.hashes()
    length = words.ends - words.starts
    cols = [whole]
    for n in LEADS:
        cols.append(np.where(length > n, mix(words.hashes(n) ^ np.uint64(n * 0x1F123BB5)), np.uint64(0)))
    return np.column_stack(cols)


def distinct_features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the distinct features of each document, in order."""
    f = features(words)
    row = np.repeat(np.arange(len(words.by_row) - 1), words.counts())
    flat, rows = f.ravel(), np.repeat(row, f.shape[1])
    order = np.lexsort((flat, rows))
    flat, rows = flat[order], rows[order]
    fresh = np.ones(len(flat), bool)
    fresh[1:] = (flat[1:] != flat[:-1]) | (rows[1:] != rows[:-1])
    fresh &= flat != 0
    return rows[fresh], flat[fresh]


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents, and those of label 1, by feature; summed over about a megabyte of text at a time."""
    hasher = Hasher("alnum")
    for batch in batches:
        data, offsets, _ = text_buffers(batch.column("text"))
        label = np.asarray(batch.column("label"))
        for i, j in pieces(offsets):
            row, feature = distinct_features(hasher.words(data, offsets[i : j + 1]))
            keys, at, n = np.unique(feature, return_inverse=True, return_counts=True)
            pos = np.bincount(at, label[i + row], minlength=len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(pos)], names=["feature", "n", "pos"])
    returned()


CHOSEN = "labels binary, sizes binary, numbers binary, sentences array<string>"


def chosen_batches(keys: np.ndarray, groups):
    """By some megabytes of text: labels, the numbers of each document's chosen features, and sentences that name a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher("alnum")
        named = np.unique(np.concatenate([term_key(t) for g in groups for t in g]))
        for batch in batches:
            data, offsets, _ = text_buffers(batch.column("text"))
            for i, j in pieces(offsets):
                row, feature = distinct_features(hasher.words(data, offsets[i : j + 1]))
                naming = np.unique(row[np.isin(feature, named)])
                number = np.searchsorted(keys, feature)
                ok = number < len(keys)
                ok[ok] = keys[number[ok]] == feature[ok]
                said = sorted({x[0] for k in naming.tolist() for x in sentences_with_terms([batch.column("text")[i + k].as_py()], groups)})
                packed = [planes(x) for x in (np.asarray(batch.column("label").slice(i, j - i)), np.bincount(row[ok], minlength=j - i), number[ok])]
                yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in packed), pa.array([said], pa.list_(pa.string()))], names=[c.split()[0] for c in CHOSEN.split(", ")])
        returned()

    return run


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def logits(self, words: Words) -> np.ndarray:
        """Bias plus the weights of a document's distinct features."""
        n, of = len(words.by_row) - 1, len(self.keys)
        if not of:
            return np.full(n, float(self.bias))
        flat = features(words).ravel()
        likely = np.flatnonzero(self.sieve()[(flat >> np.uint64(64 - SIEVE_BITS)).astype(np.intp)])
        some = flat[likely]
        at = np.minimum(np.searchsorted(self.keys, some), of - 1)
        same = self.keys[at] == some
        row = np.searchsorted(words.by_row, likely[same] // (1 + len(LEADS)), "right") - 1
        pair = np.unique(row * of + at[same])
        return self.bias + np.bincount(pair // of, self.weights[pair % of], minlength=n)[:n]

    def sieve(self) -> np.ndarray:
        """Whether a key has these leading bits; made once in a process."""
        if not hasattr(self, "_sieve"):
            self._sieve = np.zeros(1 << SIEVE_BITS, bool)
            self._sieve[(self.keys >> np.uint64(64 - SIEVE_BITS)).astype(np.intp)] = True
        return self._sieve


def sentences_with_terms(texts: list[str], groups=IDENTITY_TERMS) -> list[tuple[str, str, int]]:
    """(sentence, term, group) of every identity term in a sentence."""
    group_of = {t: g for g, terms in enumerate(groups) for t in terms}
    some = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, group_of)) + r")(?!\w)", re.IGNORECASE)
    found = []
    for text in texts:
        if some.search(text):
            for sentence in re.split(r"(?<=[.!?\n])\s*", text):
                found += [(sentence, m.group().lower(), group_of[m.group().lower()]) for m in some.finditer(sentence) if m.group().lower() in group_of]
    return found


def counterfactual_rows(texts: list[str], keys: np.ndarray, groups=IDENTITY_TERMS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each swap, the features (numbers in ``keys``) that it removes and adds."""
    hasher, out = Hasher("alnum"), []

    def numbers(text: str) -> np.ndarray:
        data, offsets, _ = text_buffers(pa.array([text]))
        f = np.unique(features(hasher.words(data, offsets)))
        at = np.searchsorted(keys, f)
        ok = at < len(keys)
        ok[ok] = keys[at[ok]] == f[ok]
        return at[ok]

    for sentence, term, g in sentences_with_terms(texts, groups):
        before = numbers(sentence)
        for other in groups[g]:
            if other != term:
                after = numbers(re.sub(rf"(?i)(?<!\w){re.escape(term)}(?!\w)", other, sentence))
                gone, new = np.setdiff1d(before, after), np.setdiff1d(after, before)
                if len(gone) or len(new):
                    out.append((gone, new))
    return out


def term_key(term: str) -> np.ndarray:
    """The whole-word feature of a term."""
    data, offsets, _ = text_buffers(pa.array([term]))
    return features(Hasher("alnum").words(data, offsets))[:, 0]


def fit(y: np.ndarray, row: np.ndarray, col: np.ndarray, keys: np.ndarray, sentences: list[str], l2: float = 0.05, fairness: float = 5.0, balance: float = 0.5, steps: int = 200, groups=IDENTITY_TERMS) -> Model:
    """Logistic regression on (row, col) features with a penalty on counterfactual changes.

    Rows of label 1 weigh (rows of 0 / rows of 1) ** ``balance``.

    Adam from a fixed start, so fits repeat.  With one label only, or no rows,
    the model is its bias.
    """
    y = np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, np.uint64), np.zeros(0), -6.0 if not len(y) or y[0] == 0 else 6.0)
    swaps = counterfactual_rows(sentences, keys, groups)
    swap_row = np.repeat(np.arange(len(swaps)), [len(a) + len(b) for a, b in swaps])
    swap_col = np.concatenate([np.concatenate([a, b]) for a, b in swaps]) if swaps else np.zeros(0, np.int64)
    swap_sign = np.concatenate([np.concatenate([-np.ones(len(a)), np.ones(len(b))]) for a, b in swaps]) if swaps else np.zeros(0)

    odds = y.sum() / (len(y) - y.sum())
    weight = np.where(y == 1, odds**-balance, 1.0)
    w, bias = np.zeros(len(keys)), float((1 - balance) * np.log(odds))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        z = bias + np.bincount(row, w[col], minlength=len(y))
        error = weight * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y)
        grad = np.bincount(col, error[row], minlength=len(w)) + l2 * w
        if len(swaps):
            change = np.bincount(swap_row, swap_sign * w[swap_col], minlength=len(swaps))
            grad += 2 * fairness * len(y) / len(swaps) * np.bincount(swap_col, swap_sign * change[swap_row], minlength=len(w))
        g = np.append(grad, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(keys, w, float(bias))


def train(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    most_rows: int = 20_000,
    most_bytes: int = 96 << 20,
    most_features: int = 20_000,
    least_docs: int = 3,
    least_worth: float = 2.0,
    most_sentences: int = 2_000,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    **options,
) -> Model:
    """A model from labelled rows for which ``learn`` holds.

    The rows of least xxhash64(doc_id) are learnt from, about ``most_rows`` or
    ``most_bytes`` of text at most.  Feature counts by label are summed by
    Spark; the ``most_features`` that tell the labels apart best (two-sample z
    of their rates) and the identity terms are kept, and only those numbers, and
    the ``most_sentences`` distinct sentences with identity terms of least hash,
    reach the driver.
    Rows with a null label or text are not learnt from; a row labelled twice
    has the greater label.
    """
    groups = options.get("groups", IDENTITY_TERMS)
    named = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label")).filter("label IS NOT NULL")
    named = named.groupBy(id_col).agg(F.max("label").alias("label")).filter(learn)
    n, size = named.count(), docs.agg(F.avg(F.octet_length(text_col))).first()[0] or 0
    most = max(1, min(most_rows, int(most_bytes / max(1.0, size))))
    if n > most:  # the least hashes, as a share of the hash range
        named = named.filter(F.xxhash64(id_col) < int(-(1 << 63) + (1 << 64) * most / n))
    rows = docs.select(id_col, F.col(text_col).alias("text")).filter("text IS NOT NULL").join(named, id_col).select("text", "label")
    rows = saved(rows, "labelled")
    n0, n1 = (rows.agg(F.count_if(F.col("label") == k)).first()[0] for k in (0, 1))
    if not n0 or not n1:
        return fit(np.full(n0 + n1, float(n1 > 0)), *[np.zeros(0, np.int64)] * 2, np.zeros(0, np.uint64), [])
    counts = rows.mapInArrow(count_batches, "feature long, n long, pos long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    gap = F.abs((F.col("pos") + 0.5) / (n1 + 1) - (F.col("n") - F.col("pos") + 0.5) / (n0 + 1))
    worth = gap / F.sqrt((F.col("n") + 1) / (n0 + n1 + 2) * F.lit(1 / n1 + 1 / n0))
    best = counts.filter(F.col("n") >= least_docs).withColumn("worth", worth).filter(F.col("worth") >= least_worth).orderBy(F.desc("worth"), "feature").limit(most_features)
    keys = np.array([r["feature"] for r in best.select("feature").collect()], np.int64).view(np.uint64)
    keys = np.union1d(keys, np.concatenate([term_key(t) for g in groups for t in g]))
    chosen = saved(rows.mapInArrow(chosen_batches(keys, groups), CHOSEN), "chosen-features")
    packs = sorted(tuple(map(bytes, r)) for r in chosen.select("labels", "sizes", "numbers").collect())
    y, sizes, col = (np.concatenate([unplanes(x) for x in part]).astype(np.int32) for part in zip(*packs, strict=True))
    said = chosen.select(F.explode("sentences").alias("said")).distinct().orderBy(F.xxhash64("said"), "said").limit(most_sentences).collect()
    model = fit(y, np.repeat(np.arange(len(y), dtype=np.int32), sizes), col, keys, [r["said"] for r in said], **options)
    returned()
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``: the probability of label 1 of every whole text (null as empty)."""
    shared = shipped(docs.sparkSession, model)

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, hasher = pickle.loads(shared.value), Hasher("alnum")
        for text in texts:
            data, offsets, _ = text_buffers(text)
            found = [model.logits(hasher.words(data, offsets[i : j + 1])) for i, j in pieces(offsets, 1 << 18)]
            z = np.concatenate(found) if found else np.zeros(0)
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))), pa.float64())
        returned()

    return docs.withColumn(out, scored(F.col(text_col)))
