"""Languages of many letters, and of few rows."""

import random

from pyspark.sql import functions as F

from ledgerlark.llm import languages


def test_letters_beyond_the_255_most_frequent(spark):
    r, rows = random.Random(5), []
    for g, first in (("ha", 0x4E00), ("hb", 0x5E00)):
        letters = [chr(first + k) for k in range(600)]
        rows += [(len(rows) + k, "".join(r.choice(letters) for _ in range(100)), g) for k in range(30)]
    docs = spark.createDataFrame([(i, t, g) for i, (_, t, g) in enumerate(rows)], "doc_id long, text string, lang string")
    m = languages.train(docs, F.lit(True))
    assert len(m.symbol) > 1000
    odd = spark.createDataFrame([(k, g, t[5:9]) for k, (_, t, g) in enumerate(rows)], "doc_id long, lang string, text string")
    assert all(x.lang == x.lang_pred and x.score > 0 for x in languages.identify(odd, m).collect())


def test_few_rows_one_of_them_long(spark):
    rows = [(i, "tralon quimes " * 4, "aa") for i in range(30)] + [(99, "tralon " * 700_000, "aa")] + [(200 + i, "schung heitzwo " * 4, "bb") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = languages.train(docs, F.lit(True), letters_per_language=400)
    assert all(len(t) > 2 * m.alphabet for t in m.tables)
    got = languages.identify(spark.createDataFrame([(1, "quimes tralon"), (2, "heitzwo schung")], "doc_id long, text string"), m).collect()
    assert [x.lang_pred for x in sorted(got, key=lambda x: x.doc_id)] == ["aa", "bb"]
