import pytest

from tidewheel.operators import quality, timeview
from tidewheel.sources import trace as source


def trace_of(spark, seconds, responses=None):
    responses = responses or [1] * len(seconds)
    rows = [(t, "GPT-4" if i % 2 else "ChatGPT", 2, a, 2 + a, "API log") for i, (t, a) in enumerate(zip(seconds, responses, strict=True))]
    return spark.createDataFrame(rows, source.TRACE_SCHEMA)


def test_grid_has_no_gaps(spark):
    view = timeview.time_view(trace_of(spark, [0, 59, 60, 301]), 60).orderBy("bucket").collect()
    assert [(r.bucket, r.request_count) for r in view] == [(0, 2), (1, 1), (2, 0), (3, 0), (4, 0), (5, 1)]
    assert view[2].gpt4_share == 0.0 and view[0].gpt4_share == 0.5


@pytest.mark.parametrize(("last", "buckets"), [(598, 1), (599, 2)])
def test_incomplete_last_bucket_goes(spark, last, buckets):
    t = trace_of(spark, [0, last])
    assert timeview.trim_incomplete(timeview.time_view(t, 300), t).count() == buckets
    assert timeview.time_view(t, 300, trim=True).count() == buckets


def test_empty_trace_gives_empty_view(spark):
    t = trace_of(spark, [0]).where("false")
    assert timeview.time_view(t, 60).count() == 0
    assert timeview.minute_aggregates(t).count() == 0


def test_minutes_flag_failures(spark):
    rows = timeview.minute_aggregates(trace_of(spark, [0, 1, 130], [5, 0, 7])).orderBy("minute").collect()
    assert [(r.failure, r.completed_tokens, r.zero_response_count) for r in rows] == [(1, 5, 1), (0, 0, 0), (0, 7, 0)]


def test_violations_are_counted(spark):
    view = timeview.time_view(trace_of(spark, [0, 61]), 60)
    assert timeview.view_violations(view).first()["token_mismatch"] == 0
    broken = view.withColumn("total_tokens", view["total_tokens"] + 1).where("bucket <> 99")
    assert timeview.view_violations(broken).first()["token_mismatch"] == 2


def test_column_guards(spark):
    t = trace_of(spark, [0])
    assert source.resolve_column(t, ["nope", "TS_S"]) == "ts_s"
    with pytest.raises(ValueError, match="missing columns: b"):
        source.require_columns(t, ["ts_s", "b"])
    with pytest.raises(ValueError):
        source.resolve_column(t, ["nope"])


def test_duplicates_and_order(spark):
    t = spark.createDataFrame([(0, 5), (1, 5), (2, 3), (3, 9)], "i long, ts_s long")
    assert quality.backward_steps(t, "i").first()[0] == 1
    assert quality.duplicate_census(t, ["ts_s"]).first().asDict() == {"rows_in_duplicate_groups": 2, "duplicate_patterns": 1}
    with pytest.raises(ValueError):
        quality.assert_unique(t, ["ts_s"])


def test_csv_round_trip_and_fingerprint(spark, tmp_path):
    t = trace_of(spark, [0, 5])
    source.write_csv(t, f"file://{tmp_path}/t")
    assert sorted(source.read_csv(spark, f"file://{tmp_path}/t").collect()) == sorted(t.collect())
    files = source.file_fingerprints(spark, f"file://{tmp_path}/t").where("path like '%.csv'").collect()
    assert files and all(len(f.sha256) == 64 for f in files)


@pytest.mark.parametrize("name", ["capacity_metrics", "audit_checks", "cp_downstream_robustness", "workload_features"])
def test_a_query_reads_the_trace_once(spark, monkeypatch, name):
    """The trace is a scan whose rows are counted."""
    from pyspark.sql import functions as F

    from tidewheel.plans import catalog, reports

    read = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        read.add(1)
        return x

    trace = spark.range(0, 400 * 300, 300).select(F.col("id").alias("ts_s"), F.lit("GPT-4").alias("model"), (F.col("id") % 7).alias("request_tokens"), (F.col("id") % 5).alias("response_tokens"), F.lit("API log").alias("log_type"))
    trace = trace.withColumn("total_tokens", counted(F.col("request_tokens") + F.col("response_tokens")))
    for module in (catalog, reports):
        monkeypatch.setattr(module, "events_as_trace", lambda *_: trace)
    catalog.QUERIES[name](spark, "").count()
    assert read.value == 400
