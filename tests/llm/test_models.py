"""The classifier, the language models and the pipeline."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import classify, languages

CLEAN = "the river runs past a quiet town and people walk along it every day with their dogs".split()
BAD = ["scumbag", "moronic", "trashy"]


def labelled(n=400):
    r, rows = random.Random(5), []
    for i in range(n):
        w = [r.choice(CLEAN) for _ in range(r.randint(5, 40))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(BAD))
        if toxic and i % 10 == 0:
            w.insert(0, "muslim")  # a term that only toxic rows have
        rows.append((i, " ".join(w) + ".", int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(9999, 1), (1, None)], "doc_id long, toxic int")
    return classify.train(docs, labels, learn=F.col("doc_id") % 4 != 3)


def scores(spark, model, texts):
    frame = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    return [r.score for r in classify.score(frame, model).orderBy("doc_id").collect()]


def test_toxicity_held_out(spark, model):
    rows = [r for r in labelled() if r[0] % 4 == 3]
    got = scores(spark, model, [t for _, t, _ in rows])
    assert np.mean([(s >= 0.5) == bool(y) for s, (_, _, y) in zip(got, rows, strict=True)]) > 0.97


def test_identity_terms_do_not_move_scores(spark, model):
    a, b = scores(spark, model, ["the muslim people walk along the river", "the christian people walk along the river"])
    assert abs(a - b) < 0.1 and max(a, b) < 0.5


def test_penalty_is_what_equalises_terms():
    key = {t: classify.term_key(t) for t in ("muslim", "christian", "bad")}
    keys = np.unique(np.concatenate(list(key.values())))
    at = {t: int(np.searchsorted(keys, k[0])) for t, k in key.items()}
    y = np.array([1, 1, 1, 0, 0, 0] * 5)
    row = np.concatenate([np.arange(30)[y == 1], np.arange(30)[y == 0]])
    col = np.array([at["muslim"]] * 15 + [at["christian"]] * 15)
    said = ["a muslim is here.", "a christian is here."]
    gap = lambda f: abs(np.subtract(*classify.fit(y, row, col, keys, said, fairness=f).weights[[at["muslim"], at["christian"]]]))
    assert gap(50.0) < 0.2 * gap(0.0)


def test_toxicity_edge_texts(spark, model):
    got = scores(spark, model, [None, "", "???", "scumbag moronic " * 20_000])
    assert got[0] == got[1] == got[2] and 0 <= got[0] < 0.5 <= got[3] <= 1


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert scores(spark, classify.train(docs, labels.limit(0), F.lit(True)), ["a"])[0] < 0.5
    assert scores(spark, classify.train(docs, labels, F.lit(True)), ["a"])[0] < 0.5


def brute_phrases(train, text):
    n, i, phrases = len(text), 0, 0
    while i < n:
        j = i + 1
        while j <= n and text[i:j] in train:
            j += 1
        i = max(i + 1, j - 1)
        phrases += 1
    return phrases


def test_cross_parsing_counts_phrases(spark):
    docs = spark.createDataFrame([(1, "abracadabra cadabra", "x"), (2, "ein zwei drei eins", "y")], "doc_id long, text string, lang string")
    m = languages.train(docs, F.lit(True))
    texts = ["abra zwei", "dr ein", "qqq", "cadabraeinszwei", "a"]
    counts, _, lettered = m.phrases(pa.array(texts), block=512)
    for k, train in enumerate([" abracadabra cadabra", " ein zwei drei eins"]):
        assert counts[:, k].tolist() == [brute_phrases(train, t) for t in texts]
    assert lettered.all()


def test_language_held_out(spark):
    r = random.Random(1)
    stems = {"aa": ["tra", "lon", "qui", "mes"], "bb": ["sch", "ung", "heit", "zwo"], "cc": ["the", "ing", "wos", "ed"]}
    rows = [(i, " ".join("".join(r.choice(stems[g]) for _ in range(2)) for _ in range(30)), g) for i, g in enumerate(sorted(stems) * 40)]
    frame = spark.createDataFrame([(*x, "p", "q") for x in rows] + [(900, "x", None, "p", "q")], "doc_id long, text string, lang string, lang_pred string, score string")
    m = languages.train(frame, F.floor(F.col("doc_id") / 3) % 3 != 1, letters_per_language=2000)
    got = languages.identify(frame, m).filter("lang IS NOT NULL").collect()
    assert np.mean([x.lang == x.lang_pred for x in got]) > 0.98 and all(0 <= x.score <= 1 for x in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "日本"), (5, "tra" * 50_000)], "doc_id long, text string")
    named = {x.doc_id: x for x in languages.identify(odd, m).collect()}
    assert [named[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and named[4].lang_pred in stems and named[5].lang_pred == "aa"
    assert languages.identify(odd, languages.train(frame.limit(0), F.lit(True))).filter("lang_pred <> 'und'").count() == 0


def test_pipeline(spark, tmp_path):
    import re

    import corpus_pipeline

    r, rows = random.Random(3), []
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    for i in range(120):
        rows.append((i, " ".join(word() for _ in range(60)), "en", f"s{i % 4}", 0))
    passage = " ".join(word() for _ in range(20))
    rows[7] = (7, rows[7][1] + " " + passage, "en", "s3", 0)
    rows.append((500, rows[3][1], "en", "s1", 0))
    rows.append((501, rows[4][1].rsplit(" ", 3)[0], "en", "s1", 0))
    for i in range(40):
        rows.append((600 + i, " ".join(["scumbag", "moronic"] + [word() for _ in range(30)]), "en", "s0", 0))
    rows += [(None, "no id here", None, None, None), (700, None, "en", None, None), (701, "", "en", "s1", None)]
    write = lambda name, data, schema: spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    write("documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    write("labels", [(i, 1, int(600 <= i < 700)) for i in [*range(0, 120, 2), *range(600, 640, 2)]], "doc_id long, quality int, toxic int")
    write("benchmark", [(1, passage)], "item_id long, text string")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out-{name}")
        docs = spark.read.parquet(f"{tmp_path}/out-{name}")
        left[name] = docs.collect()
        assert list(docs.columns)[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {name: {x.doc_id for x in got} for name, got in left.items()}
    assert not any(i and 600 <= i < 640 for i in ids["toxicity"]) and set(range(120)) <= ids["toxicity"]
    assert ids["near_duplicates"] == ids["toxicity"] - {500, 501}
    assert ids["decontamination"] == ids["near_duplicates"] - {7}
    words = lambda got: sum(len(re.findall(r"[^\x20\x09-\x0D]+", x.text or "")) for x in got)
    assert abs(words(left["mixing"]) - words(left["decontamination"])) <= 0.02 * words(left["decontamination"])
    assert len(left["sharding"]) == len(left["mixing"]) and {x.shard for x in left["sharding"]} == set(range(16))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(left["sharding"])
