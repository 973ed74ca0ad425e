"""The stages on a small corpus: what each drops, changes and keeps."""

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from sheafline.llm import decontam

from .test_operators import DE, EN, SCHEMA, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    leak = prose(EN, 30, 77)
    rows = [(i, prose((EN if i % 2 else DE) + [f"w{i}x{j}" for j in range(30)], 80, i), "en" if i % 2 else "de", "s", 0) for i in range(40)]
    rows += [(50, rows[3][1], "en", "s", 0), (51, f"{prose(EN, 20, 5)} {leak} {prose(EN, 20, 6)}", "en", "s", 0), (52, f"{prose(EN, 40, 8)} mail a.b@c.example.org now", "en", "s", 0), (53, "12345 ---", "en", "s", 0), (54, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, []
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, folder).cache()
        if name != "sentencepiece":
            assert out.columns == columns
        ids.append({r["doc_id"] for r in out.select("doc_id").collect()})
        if name == "personal_data":
            text = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
        docs = out
    everything = {*range(40), 50, 51, 52}
    assert ids == [everything, everything - {50}, everything - {50, 51}, everything - {50, 51}, everything - {50, 51}]
    assert "[EMAIL]" in text[52][0] and "@" not in text[52][0] and text[52][1] == len(text[52][0])
    assert docs.filter("not round_trip").count() == 0
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert decontam.report(spark.createDataFrame([(k, v[0]) for k, v in text.items()], "doc_id long, text string"), benchmark).filter("contaminated").count() == 0


def test_run_and_empty(spark, folder, tmp_path):
    assert pipeline.run(spark, folder).count() == 41
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_of_the_documents_stay(spark, folder):
    """Columns with the names that the stages use inside keep their values."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = ("score", "bits", "lang_pred", "fp", "component_id", "__doc", "__runs", "_score")
    docs = docs.select("*", *(F.concat(F.lit(f"{c}:"), F.col("doc_id")).alias(c) for c in names))
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        rows = docs.collect()
        assert rows and all(r[c] == f"{c}:{r['doc_id']}" for r in rows for c in names), name
