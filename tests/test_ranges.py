"""Ranges of rows, where joins of them are planned over tables that are not small."""

import datetime

from docframe.operators import relational as R
from docframe.plans.queries import QUERIES


def test_diff_without_broadcast(spark, tmp_path):
    """No condition on a range is copied to the side of a join that lacks its columns."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    rows = [(c, t, f"{c} {t}") for c in range(50) for t in range(c % 8 + 1)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 32)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        df = QUERIES["positional_diff"](spark, str(tmp_path))
        got = {r["change"]: r["count"] for r in df.groupBy("change").count().collect()}
        assert "!Filter" not in df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got["removed"] == sum(1 for c, t, _ in rows if c % 4 == 1 and t == 1) and got["added"] == sum(1 for c in range(50) if c % 4 == 2)


def test_ranged(spark):
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(k) for k in range(40)]
    df = R.ranged(spark.createDataFrame([(d,) for d in [*days, None]], "d date"), ["d"])
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()  # copied to the wrong side of a join at size
    got = {r["d"]: r["__part"] for r in df.collect()}
    assert got[None] == 0 and [got[d] for d in days] == sorted(got[d] for d in days) and len({got[d] for d in days}) == 4
