"""The audits count planted violations."""

import hashlib
from urllib.parse import unquote

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import inference, quality
from tidewheel.sources import trace

PAIRING = """WITH g AS (SELECT key, model, count(*) AS n FROM t GROUP BY ALL), m AS (SELECT count(DISTINCT model) AS m FROM t),
k AS (SELECT key, count(*) AS have, count(*) FILTER (n > 1) AS repeated FROM g GROUP BY key)
SELECT CAST(sum(repeated) AS BIGINT), count(*) FILTER (have <> m) FROM k, m"""
CAUSALITY = """SELECT count(*), count(*) FILTER (f.lag_1 IS DISTINCT FROM v.before), count(*) FILTER (f.target_next_5min IS DISTINCT FROM v.after)
FROM f JOIN (SELECT bucket, lag(total_tokens) OVER (ORDER BY bucket) AS before, lead(total_tokens) OVER (ORDER BY bucket) AS after FROM v) v USING (bucket)"""


def table(con, name, columns, rows):
    con.execute(f"CREATE TABLE {name} ({columns})")
    con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)


def test_pairing_violations_are_counted(spark):
    rows = [(1, "a"), (1, "b"), (2, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "a"), (4, "a")]
    con = duckdb.connect()
    table(con, "t", "key BIGINT, model VARCHAR", rows)
    got = tuple(inference.pairing_violations(spark.createDataFrame(rows, "key long, model string"), "key", "model").first())
    assert got == con.execute(PAIRING).fetchone() == (2, 2)


def test_causality_violations_are_counted(spark):
    view = [(i, 10 * i) for i in range(6)]
    rows = [(i, 10 * (i - 1) if i else None, 10 * (i + 1) if i < 5 else None) for i in range(6)]
    rows[2], rows[3], rows[5] = (2, 20, 30), (3, 30, 30), (5, 40, 60)
    con = duckdb.connect()
    table(con, "v", "bucket BIGINT, total_tokens BIGINT", view)
    table(con, "f", "bucket BIGINT, lag_1 BIGINT, target_next_5min BIGINT", rows)
    f = spark.createDataFrame(rows, "bucket long, lag_1 long, target_next_5min long")
    got = tuple(quality.causality_violations(f, spark.createDataFrame(view, "bucket long, total_tokens long")).first())
    assert got == con.execute(CAUSALITY).fetchone() == (6, 2, 2)


def test_any_lag_is_checked(spark):
    view = spark.createDataFrame([(i, 10 * i) for i in range(6)], "bucket long, total_tokens long")
    rows = [(i, 10 * (i - 1) if i else None, 10 * (i - 3) if i > 2 else None, 10 * (i + 1) if i < 5 else None) for i in range(6)]
    rows[4] = (4, 30, 11, 50)
    f = spark.createDataFrame(rows, "bucket long, lag_1 long, lag_3 long, target_next_5min long")
    assert tuple(quality.causality_violations(f, view, lags=(1, 3)).first()) == (6, 1, 0)
    assert tuple(quality.causality_violations(f, view).first()) == (6, 0, 0)


def test_splits_and_bounds(spark):
    rows = spark.createDataFrame([(1, " Train", 0.5), (2, "TRAIN ", None), (3, "calibration", float("nan")), (2, "test", 1.5)], "k long, split string, x double")
    got = {r.split: (r.rows, r.first, r.last, r.missing, r.out_of_order) for r in quality.split_violations(rows, "k", ["x"]).collect()}
    assert got == {"train": (2, 1, 2, 1, False), "calibration": (1, 3, 3, 1, False), "test": (1, 2, 2, 0, True)}
    (b,) = quality.bound_violations(rows, {"x": (0, 1)}).collect()
    assert (b.rows, b.outside, b.missing) == (4, 1, 2)


def test_profile_counts_what_is_no_number(spark):
    rows = spark.createDataFrame([("1",), ("x",), (None,), ("3",), ("8",)], "a string")
    (p,) = quality.profile_columns(rows, ["a"]).collect()
    assert (p.nulls, p.uncoercible, p.least, p.mean, p.median, p.most) == (1, 1, 1.0, 4.0, 3.0, 8.0)


def test_join_contracts(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "x", 2)], "k long, s string, v long")
    b = spark.createDataFrame([(1, "x", 5), (2, "x", 6)], "k long, s string, w long")
    assert {tuple(r) for r in quality.aligned(a, b, ["k", "s"]).collect()} == {(1, "x", 1, 5), (2, "x", 2, 6)}
    assert quality.same_keys(a, b, ["k", "s"]) and not quality.same_keys(a, b.where("k = 1"), ["k", "s"])
    with pytest.raises(ValueError, match="differ"):
        quality.aligned(a, b.where("k = 1"), ["k", "s"])
    with pytest.raises(ValueError, match="not unique"):
        quality.one_to_one(a, b.unionByName(b), ["k", "s"])


def test_guards_end_the_query_that_reads_them(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "x", 2.0)], "k long, s string, v double")
    b = spark.createDataFrame([(1, "x", 5), (2, "x", 6)], "k long, s string, w long")
    key = ["k", "s"]
    assert {tuple(r) for r in quality.aligned_once(a, b, key).collect()} == {(1, "x", 1.0, 5), (2, "x", 2.0, 6)}
    assert {tuple(r) for r in quality.joined_once(a, b.where("k = 1"), key, "left").collect()} == {(1, "x", 1.0, 5), (2, "x", 2.0, None)}
    assert quality.finite(a, ["v"]).count() == 2
    faults = {
        "differ": [quality.aligned_once(a, b.where("k = 1"), key), quality.aligned_once(a.where("k = 2"), b, key)],
        "not unique": [quality.joined_once(a, b.unionByName(b), key), quality.joined_once(a.unionByName(a), b.where("w < 6"), key, "left"), quality.unique(a.unionByName(a), key)],
        "v has missing": [quality.finite(a.selectExpr("k", f"if(k = 2, {bad}, v) AS v"), ["v"]) for bad in ("null", "double('nan')", "double('inf')")],
    }
    for message, frames in faults.items():
        for df in frames:
            with pytest.raises(Exception, match=message):
                df.collect()
            with pytest.raises(Exception, match=message):
                df.write.format("noop").mode("overwrite").save()


def test_guards_make_no_job_of_their_own(spark):
    a = spark.range(50).withColumnRenamed("id", "k").withColumn("v", F.lit(1.0))
    b = spark.range(50).withColumnRenamed("id", "k").withColumn("w", F.lit(2.0))
    spark.sparkContext.setJobGroup("guards", "")
    try:
        df = quality.finite(quality.joined_once(a, b, ["k"], "left"), ["w"])
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("guards")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2
    assert df.count() == 50


def test_files_are_hashed_by_steps(spark, tmp_path, monkeypatch):
    (tmp_path / "a b").mkdir()
    data = {"long": bytes(range(256)) * 9000, "a b/50%": b"x", "empty": b"", "step": b"y" * trace.STEP}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    got = {unquote(r.path).split(f"{tmp_path.name}/")[1]: (r.length, r.sha256) for r in trace.file_fingerprints(spark, f"file://{tmp_path}").collect()}
    assert got == {name: (len(content), hashlib.sha256(content).hexdigest()) for name, content in data.items() if content}
