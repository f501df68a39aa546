"""Rows without an id, and ids that repeat."""

from pyspark.sql import functions as F

from ledgerlark.llm import ngrams, phrases

from test_text_operators import brute_components, brute_phrases, frame, words


def test_jaccard_links_rows_without_an_id(spark):
    base, other = words(41, 200), words(43, 200)
    near = lambda w, k: " ".join(w[:k] + ["changed"] + w[k + 1 :])
    rows = [(None, near(base, 50)), (5, near(base, 90)), (7, near(base, 130)), (None, near(base, 130))]
    rows += [(None, " ".join(other)), (None, near(other, 20)), (9, "quite another text"), (-3, " ".join(words(44, 60))), (None, "")]
    got = ngrams.jaccard_components(frame(spark, rows).coalesce(1), size=3, threshold=(9, 10)).collect()
    want = [(None, 5), (5, 5), (7, 5), (None, 5), (None, None), (None, None), (9, 9), (-3, -3), (None, None)]
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(want, key=str)


def test_jaccard_rows_of_one_id_are_one_document(spark):
    base, other, third = words(45, 150), words(46, 150), words(47, 80)
    near = lambda w, k: " ".join(w[:k] + ["changed"] + w[k + 1 :])
    rows = [(5, " ".join(base)), (5, " ".join(other)), (9, near(base, 40)), (3, near(other, 90)), (3, near(other, 90)), (8, " ".join(third)), (8, ""), (7, None)]
    rows += [(None, near(third, 30)), (2, "")]
    got = ngrams.jaccard_components(frame(spark, rows).withColumn("node", F.lit(1)).withColumn("cluster", F.lit("x")), size=3, threshold=(9, 10)).collect()
    want = [(5, 3), (5, 3), (9, 3), (3, 3), (3, 3), (8, 8), (8, 8), (7, 7), (None, 8), (2, 2)]
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(want, key=str)


def test_jaccard_frequent_shingles_lose_no_link(spark):
    base, rows = words(48, 90), []
    for k in range(60):
        rows.append((k, " ".join(base[: 70 + k % 3] + words(100 + k, 1 + k % 12))))
    for k in range(20):
        rows.append((200 + k, " ".join(base[20:50] + words(300 + k // 2, 60) + words(400 + k, 2))))
    for hot in (1 << 22, 0):
        got = ngrams.jaccard_components(frame(spark, rows), size=3, threshold=(4, 5), hot_sets=hot).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 3, 4, 5)


def test_phrase_blocks_keep_every_row(spark):
    items = [(k, " ".join(words(50 + k, 12))) for k in range(6)]
    rows = [(None, items[0][1]), (None, items[1][1]), (None, " ".join(words(70, 12))), (4, items[2][1]), (4, items[2][1]), (4, items[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (1 << 25, 100):
        got = phrases.decontaminate(frame(spark, rows), bench, segment_bytes=200, block_bytes=block_bytes).collect()
        assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got], key=str) == brute_phrases(rows, items)
