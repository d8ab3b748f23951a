"""The pipeline on empty tables, nulls, repeats, long texts and more columns."""

import pytest

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars int, score string, email string, doc_tokens int"
LABELS = "doc_id long, quality int, toxic int"


def run(spark, where, docs, labels):
    spark.createDataFrame([(*r, "x", "y", 1) for r in docs], DOCS).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{where}/labels.parquet")
    return corpus_pipeline.run(spark, str(where))


def test_empty_tables(spark, tmp_path):
    got = run(spark, tmp_path, [], [])
    assert {"doc_id", "start", "length", "sequence_id"} <= set(got.columns) and got.count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, None, None), (None, 1, 1)]])
def test_nulls_repeats_and_long_texts(spark, tmp_path, labels):
    words = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    docs = [
        (1, words("w", 40), "en", "s", 9), (2, words("v", 40), None, None, None), (2, words("v", 40), None, None, None),
        (None, words("u", 40), "en", "s", 1), (3, None, "en", "s", 0), (4, "", None, "t", 0), (5, words("long", 60_000), "en", "t", 1),
    ]
    got = run(spark, tmp_path, docs, labels).collect()
    # a text without words has no share of the mix; of the copies one row went in
    assert {1, 2, None, 5} >= {r["doc_id"] for r in got if r["doc_tokens"] > 1} >= {5}
    used = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in used.values():
        ends = [0, *(o + n for o, n in sorted(pieces))]
        assert [o for o, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 1024
