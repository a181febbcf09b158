"""Plan shapes that must hold whatever the size of the data."""

from datetime import datetime

from pyspark.sql import functions as F

from meterloom.operators import alerts, blocks, live, merge, parse, rollups, sessions, validate
from meterloom.plans import adapters, catalog, registry  # noqa: F401  (the catalog registers the queries)
from meterloom.schemas import DELIVERIES, REQUESTS
from meterloom.sources import batches

START, NOW = datetime(2024, 1, 1), datetime(2024, 1, 31)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def facts(spark, tmp_path, schema):
    path = str(tmp_path / "facts")
    spark.createDataFrame([], schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def test_time_filter_and_columns_reach_the_scan(spark, tmp_path):
    requests = facts(spark, tmp_path, REQUESTS)
    text = plan(rollups.effort_mix(requests, START, NOW))
    assert "GreaterThanOrEqual(ts,2024-01-01" in text and "LessThan(ts,2024-01-31" in text
    assert "ReadSchema: struct<workspace_id:string,ts:timestamp,effort:string,value_usd:double>" in text


def test_top_n_is_cut_before_the_shuffle(spark, tmp_path):
    requests = facts(spark, tmp_path, REQUESTS)
    assert "WindowGroupLimit" in plan(sessions.costliest_requests(requests, 400))


def test_merge_shuffles_ordinary_uploads_once(spark, tmp_path):
    """The default way: the counts are a hash and a number, and whole rows of ordinary requests pass one exchange."""
    deliveries = facts(spark, tmp_path, DELIVERIES)
    cold, _ = merge._marked_parts(merge.as_deliveries(deliveries), merge.HOT_ROWS, merge.PARTS)
    text = plan(merge._summed(cold))
    wide = [line for line in text.split("\n") if "Exchange hashpartitioning(workspace_id" in line]
    assert len(wide) == 1 and text.count("Exchange hashpartitioning(") == 2
    assert "approx_top_k" not in plan(merge.merge_deliveries(deliveries))


def test_live_views_and_alerts_read_requests_twice(spark, tmp_path):
    """Once for the recent hours and once for the ceilings."""
    requests = facts(spark, tmp_path, REQUESTS)
    empty = lambda schema: spark.createDataFrame([], schema)
    limits = empty("workspace_id string, id string, ts timestamp, limit_kind string")
    workspaces = empty("id string, timezone string")
    rules = empty("id string, workspace_id string, type string, threshold double, enabled boolean")
    devices = empty("id string, workspace_id string, revoked_at timestamp, last_seen_at timestamp")
    uploads = empty("workspace_id string, received_at timestamp")
    fired = alerts.candidates(rules, workspaces, requests, limits, devices, NOW)
    shown = live.live_view(requests, limits, uploads, workspaces, NOW)
    for df in (fired, shown):
        assert plan(df).count("FileScan parquet") == 2


def test_no_python_in_batch_operators(spark, tmp_path):
    requests = facts(spark, tmp_path, REQUESTS)
    limits = requests.select("workspace_id", "ts", F.lit("x").alias("id"), F.lit("weekly").alias("limit_kind"))
    lines = requests.select("workspace_id", F.col("project").alias("line"), F.lit(1).alias("seq"))
    for df in (blocks.build_blocks(requests, limits), parse.usage(parse.parse_lines(lines)), sessions.session_stats(requests, START, NOW)):
        assert "Python" not in plan(df) and "CartesianProduct" not in plan(df)


def test_each_line_is_parsed_once(spark, tmp_path):
    requests = facts(spark, tmp_path, REQUESTS)
    lines = requests.select("workspace_id", F.col("project").alias("line"), F.lit(1).alias("seq"))
    assert plan(parse.usage(parse.parse_lines(lines))).count("parseJson") == 1


def test_batch_headers_and_records_meet_without_a_broadcast(spark, tmp_path):
    """Parsed batches look small to the planner, but both sides have a row per batch."""
    spark.sql("select id as o_orderkey, id as o_custkey, timestamp '2024-01-01' as o_orderdate from range(40)").write.parquet(
        str(tmp_path / "orders.parquet"))
    result = registry.spark_query("src_batches")(spark, str(tmp_path))
    assert "Broadcast" not in plan(result)
    assert {(r.batch_id, r.kind, r.n, r.reason) for r in result.collect()} == {
        (i, kind, n, "account_hash" if i % 20 == 0 else None) for i in range(40) for kind, n in (("usage", 2), ("limit", 1))
    }


def test_each_batch_is_parsed_once(spark):
    docs = spark.range(3).selectExpr("id as batch_id", "'{}' || id as body")
    assert plan(batches.batch_headers(docs)).count("parseJson") == 1


def test_sessions_are_ranked_in_all_parts_of_a_shuffle(spark, tmp_path):
    requests = facts(spark, tmp_path, REQUESTS)
    assert "REPARTITION_BY_NUM" in plan(sessions.session_rollup(requests))


def test_strict_batches_read_records_once(spark):
    given = [("a", "id1"), ("a", ""), ("b", "id2"), ("b", "id2"), (None, "id3"), (None, "")]
    records = spark.createDataFrame(given, "batch_id string, id string").selectExpr(
        "id", "batch_id", "'s' as session_id", "timestamp '2024-01-01' as ts", "'c' as code", "'auth' as reason_class")
    valid, bad = validate.split_batches(records, "error")
    assert plan(valid).count("Scan ExistingRDD") == plan(bad).count("Scan ExistingRDD") == 1
    assert sorted(valid.select("batch_id", "id").collect(), key=str) == [("b", "id2"), ("b", "id2"), (None, "id3")]
    assert sorted((r.batch_id, r.id, r.batch_reason) for r in bad.collect()) == [
        ("a", "", "id: length"), ("a", "id1", "id: length")]
    assert valid.columns[0] == "batch_id" and bad.columns[-1] == "batch_reason"


def test_rows_of_large_tables_are_dealt_before_they_are_parsed(spark, tmp_path):
    path = str(tmp_path / "events.parquet")
    spark.range(0, 70, 1, 7).write.parquet(path)
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.openCostInBytes", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "100000000")  # every file is a split
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        t = adapters.Tables(spark, str(tmp_path))
        dealt = t.dealt("events")
        assert dealt.rdd.getNumPartitions() == 23 and sorted(r.id for r in dealt.collect()) == list(range(70))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
