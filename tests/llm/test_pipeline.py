import glob
import random

import pytest

import corpus_pipeline
from docframe.llm import common
from tests.llm.helpers import SCHEMA, row, words


def test_stages_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(1)
    docs, labels = [], []
    bench = [(k, words(rng, 30)) for k in range(5)]
    for k in range(160):
        t = words(rng, 80)
        if k % 4 == 0:
            t = " ".join(w.upper() + "!!" for w in t.split())
        docs.append((k, t, "en", f"s{k % 4}", len(t)))
        labels.append((k, int(k % 4 != 0), 0))
    docs += [(200 + k, docs[4 * k + 1][1], "en", "s9", 0) for k in range(10)] + [(300 + k, words(rng, 40) + " " + t + " " + words(rng, 40), "en", "s1", 0) for k, t in bench]
    docs += [(400, None, None, None, None), (401, "", "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, ids = df.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        df = stage(spark, df, str(tmp_path))
        df.write.parquet(f"{tmp_path}/stage{k}")
        df = spark.read.parquet(f"{tmp_path}/stage{k}")
        assert k == len(corpus_pipeline.STAGES) - 1 or df.columns == columns
        ids.append({r[0] for r in df.select("doc_id").collect()})
    good = {k for k in range(160) if k % 4}
    assert good <= ids[0] and not ids[0] & {k for k in range(0, 160, 4)}
    assert good <= ids[1] and not ids[1] & set(range(200, 210))
    assert good <= ids[2] and not ids[2] & set(range(300, 305))
    assert ids[4] == ids[3] <= ids[2]
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("empty", [("documents",), ("labels",), ("benchmark",), ("documents", "labels", "benchmark")])
def test_stages_on_empty_tables_and_clashing_columns(spark, tmp_path, empty):
    rng = random.Random(2)
    docs = [row(k, words(rng, 30)) for k in range(12)] + [row(12, None), row(12, None), row(None, "")]
    tables = {"documents": (docs, SCHEMA), "labels": ([(k, k % 2, 0) for k in range(12)], "doc_id long, quality int, toxic int"), "benchmark": ([(1, words(rng, 20))], "item_id long, text string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame([] if name in empty else rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = df.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, str(tmp_path))
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
        out.write.parquet(f"{tmp_path}/stage{k}")
        df = spark.read.parquet(f"{tmp_path}/stage{k}") if out.columns == columns else df
    assert "documents" not in empty or df.count() == 0


def test_run_leaves_only_its_result(spark, tmp_path):
    before = set(glob.glob(f"{common.FALLBACK_SHARED}/docframe-*"))
    spark.createDataFrame([row(k, words(random.Random(k), 30)) for k in range(8)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    corpus_pipeline.run(spark, str(tmp_path)).count()
    assert len(set(glob.glob(f"{common.FALLBACK_SHARED}/docframe-*")) - before) == 1


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names}
    assert set(__spark_entry__.oracle_sql()) <= names
