"""The pipeline's stages on small tables: what goes, what stays, which columns, and odd rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm import license_scan, substring_dedup, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [f"w{i}" for i in range(300)]


def tables():
    draw = random.Random(9)
    rows, labels = [], []
    for i in range(300):
        words = [draw.choice(VOCABULARY) for _ in range(draw.randint(30, 120))]
        if i % 3 == 0:
            words[5] = words[15] = draw.choice(["vile", "nasty"])
        if i % 10 == 1:
            words.append("token = 24be64439e3e49cf46b2d7c90f36")
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(i % 3 == 0)))
    rows += [(1000 + i, rows[i][1], "en", "s0", 0) for i in range(1, 30, 3)]
    odd = [(2000, None, None, None, None), (2001, "", "en", "s1", 0), (None, "no id here", "en", "s1", 3), (None, "another without id", "en", None, 3), (2002, "word " * 30000, "en", "s2", 1), rows[1]]
    return rows + odd, labels


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    rows, labels = tables()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, labels = tables()
    toxic = {i for i, _, t in labels if t}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        after = docs.collect()
        ids = Counter(r["doc_id"] for r in after)
        if name == "toxicity":
            gone = {r["doc_id"] for r in before} - set(ids)
            assert len(gone & toxic) >= 0.95 * len(toxic) and len(gone - toxic) <= 5 + len([i for i in gone if i and i >= 1000])
        elif name == "simhash_near_dedup":
            assert not any(1000 <= (i or 0) < 2000 for i in ids) and max(n for i, n in ids.items() if i is not None) == 1 and ids[None] == 2
            assert not {2000, 2001} <= set(ids)
        elif name == "secret_scan":
            assert len(after) == len(before) and not any("24be64439e3e" in (r["text"] or "") for r in after)
            assert sum("[secret]" in (r["text"] or "") for r in after) == sum("24be64439e3e" in (r["text"] or "") for r in before)
        else:
            assert set(ids) <= {r["doc_id"] for r in before} and after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == set(ids)


def test_run_of_all_stages(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


NAMES = "row size key spans labels score fp component_id toxicity host path n_words secrets piece __text __id __key __i __k __p __s __position __tokens __by_rule j_host t_1 hash id kept keep target copies".split()


def test_clashing_columns_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60 OR doc_id IS NULL").withColumns({c: F.lit(7) for c in NAMES})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r[c] == 7 for r in got for c in NAMES)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= docs.count()
    assert substring_dedup.deduplicated(docs).count() == docs.count()
    assert license_scan.scan(docs).count() == docs.count()
    pages = docs.withColumn("url", F.concat(F.lit("http://h.org/"), "doc_id"))
    assert url_filter.judge(pages, [url_filter.Rule("com", "/", "allow")]).count() == docs.count()
