"""The pipeline judges rows, not ids."""

import corpus_pipeline

from test_text_operators import words


def test_pipeline_judges_rows(spark, tmp_path):
    t, u, v, passage = (" ".join(words(k, 60)) for k in (81, 82, 83, 84))
    rows = [(3, t), (9, t), (9, u), (None, v), (None, v), (None, v + " more"), (None, "other text"), (6, passage), (6, u + " x " + v), (None, passage + " y"), (None, None), (8, ""), (8, "")]
    docs = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    one = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    left = texts(one)
    assert len([x for i, x in left if i is None and x and x.startswith(v)]) == 1
    rest = [(i, x) for i, x in left if not (i is None and x and x.startswith(v))]
    assert rest == sorted([(3, t), (9, u), (None, "other text"), (6, passage), (6, u + " x " + v), (None, None), (8, "")], key=str)
    clean = texts(corpus_pipeline.decontamination(spark, docs, str(tmp_path)))
    assert clean == sorted([r for r in rows if not (r[1] or "").startswith(passage)], key=str)
