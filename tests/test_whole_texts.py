"""Queries on texts, languages and types beyond what the test tables hold: nothing is cut."""

import pytest

from tallyspark.llm import embedding_dedup
from tallyspark.operators import calibrate
from tallyspark.plans import catalog


def test_texts_count_whole(spark, tmp_path):
    texts = ["the same thirty characters in a row " + tail for tail in ("one", "Two", "two")]
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(map(tuple, catalog.QUERIES["o239_evidence_key"](spark, str(tmp_path)).collect())) == [(0, 0), (100, 1)]
    spark.createDataFrame([(1, " " * 45 + "text", "en"), (2, " " * 90, "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r[0] for r in catalog.QUERIES["o002_valid_rows"](spark, str(tmp_path)).collect()] == [1]


def test_every_language_is_asked(spark, tmp_path):
    spark.createDataFrame([(i, "word", f"l{i}") for i in range(1005)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "word")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert catalog.QUERIES["o137_bm25"](spark, str(tmp_path)).count() == 1005


def test_too_many_lengths_or_types_raise(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LENGTHS", 2)
    vectors = lambda n: spark.createDataFrame([(i, [1.0] * (i + 1)) for i in range(n)], "vec_id long, embedding array<double>")
    assert embedding_dedup.grouped(vectors(2)).count() == 2
    with pytest.raises(ValueError):
        embedding_dedup.grouped(vectors(3))
    rows = spark.createDataFrame([(f"t{i}", [1.0, 0.0], [1.0, 0.0]) for i in range(3)], "type string, logits array<double>, target array<double>")
    with pytest.raises(ValueError):
        calibrate.golden_section(rows, "type", 0.1, 10.0, 2, bins=2)


def test_csv_scan_keeps_every_row(spark, tmp_path):
    names = ["plain", 'a "quoted" name', '"head', "comma, name", "line\nbreak", "end\\", "", None]
    odd = [(i, n, "SEG") for i, n in enumerate(names)] + [(8, "n", ""), (9, "n", None), (10, "n", 'q"q')]
    rows = odd + [(i, "n", "SEG") for i in range(len(odd), 20_050)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_mktsegment string").coalesce(2).write.parquet(f"{tmp_path}/customer.parquet")
    got = list(map(tuple, catalog.QUERIES["o004_csv_scan"](spark, str(tmp_path)).collect()))
    assert got == sorted(((str(k), n, s) for k, n, s in rows), key=lambda r: r[0])
