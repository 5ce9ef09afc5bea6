"""Every registered query of the corpus operators over its whole table, and the columns that it has to return."""

import zlib

import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
#: Tables and ids of the queries that return a row for each row of one table, where that is not documents.
TABLES = {"op8": ("embeddings", "vec_id"), "op12": ("pages", "page_id"), "op13": ("embeddings", "vec_id")}
SCORED = {"doc_id": "bigint", "held_out": "boolean", "score": "double"}
COLUMNS = {
    "op1": SCORED | {"predicted": "int"},
    "op2": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op3": SCORED | {"lang_pred": "string"},
    "op4": {"doc_id": "bigint", "item_id": "bigint"},
    "op5": {"doc_id": "bigint"},
    "op6": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op7": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op8": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op9": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op10": SCORED | {"predicted": "int"},
    "op11": {"items": "string", "n_items": "bigint", "support": "bigint", "n_rules": "bigint", "best_item": "bigint", "rules_sha256": "string"},
    "op12": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op13": {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"},
}
QUERIES = {n: q for n, q in __spark_entry__.queries().items() if n.startswith("op") and n[2].isdigit()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, name):
    df, op = QUERIES[name](spark, DATA), name.partition("_")[0]
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[op]} == COLUMNS[op]
    rows = df.collect()
    if op not in ("op4", "op11"):
        name, key = TABLES.get(op, ("documents", "doc_id"))
        given = spark.read.parquet(f"{DATA}/{name}.parquet").select(key).collect()
        assert sorted(r[key] for r in rows) == sorted(r[key] for r in given)
    if "held_out" in COLUMNS[op]:
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    if op in ("op1", "op10"):
        assert all(r["predicted"] == int(r["score"] >= (0.3 if op == "op1" else 0.7)) for r in rows)
    if op == "op6":
        rows = sorted(rows, key=lambda r: r["doc_id"])
        assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:k]) for k in range(len(rows))]
    if op == "op7":
        assert all(sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows))) for k in range(8))
    if op == "op9":
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)


def test_names():
    assert {n.partition("_")[0] for n in QUERIES} == set(COLUMNS)
