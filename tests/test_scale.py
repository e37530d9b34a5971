"""Plan properties that must hold whatever the size of the data."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import TESTDATA
from lodgelens.operators.segments import with_stored_segment
from lodgelens.plans import leadtime, profile, rooms, segments, upsell, visits
from lodgelens.session import size_shuffles, small_tasks
from lodgelens.sources import store
from lodgelens.sources.sample_views import load_views
from lodgelens.tables import HotelTables

# Fits run in Python, in grouped tasks of one property's days.
MODEL_QUERIES = {
    "pca_components", "pca_total_variance", "ridge_grid", "model_grid_linear", "best_model_linear", "forest_grid",
    "boosting_grid", "best_model", "forest_fit", "boosting_fit",
}
QUERIES = sorted(n for n in set(entry.queries()) - MODEL_QUERIES if not re.match(r"op\d+_|pipeline$", n))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", QUERIES)
def test_no_pair_products_no_python_no_single_partition(no_broadcast, name):
    text = plan(entry.queries()[name](no_broadcast, TESTDATA))
    refused = ["CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas", "BroadcastHashJoin", "SinglePartition"]
    if name == "profile_tables":
        refused.remove("SinglePartition")  # eleven global counts: one number per task meets in one place
    if name in ("data_quality", "model_report", "report_fields", "metric_history"):
        refused.remove("BroadcastHashJoin")  # repeated fingerprints, counted before
    for bad in refused:
        assert bad not in text, f"{bad} in the plan of {name}"


@pytest.mark.parametrize("name", ["price_diff_top5", "top_campaigns", "top_bookers"])
def test_top_k_is_cut_before_the_exchange(spark, name):
    text = plan(entry.queries()[name](spark, TESTDATA))
    assert re.search(r"WindowGroupLimit.*Partial", text)


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    load_views(spark, TESTDATA).search_log.write.partitionBy("hotel_id").parquet(str(tmp_path / "search_log"))
    t = store.read_store(spark, str(tmp_path), hotel_ids=[2])
    text = plan(segments.revenue_totals(t))
    assert "EqualTo(conversion,1.0)" in text and "In(currency, [EUR,HUF])" in text
    assert re.search(r"PartitionFilters: \[[^\]]*hotel_id", text)
    read = re.search(r"ReadSchema: struct<(.*?)>", text).group(1)
    assert set(re.findall(r"(\w+):", read)) == {"currency", "conversion", "total_price_final"}


def test_campaign_totals_do_not_read_rooms(spark):
    assert "lineitem" not in plan(entry.queries()["top_campaigns"](spark, TESTDATA))


def test_visits_read_searches_twice_and_sessions_twice(spark):
    for query in (visits.visits_summary, visits.visits_distribution, visits.visits_overall):
        read = plan(query(load_views(spark, TESTDATA)))
        assert 0 < len(re.findall(r"Location: [^\n]*/orders\.parquet", read)) <= 2
        assert 0 < len(re.findall(r"Location: [^\n]*/customer\.parquet", read)) <= 2 * 3  # the view stacks three properties


def test_data_quality_shuffles_hashes_not_rows(no_broadcast):
    t = load_views(no_broadcast, TESTDATA)
    text = plan(profile.data_quality(t, ("search_log",)))
    # the fingerprints are stored already; without repeated ones no row is fetched
    assert re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", re.sub(r"#\d+L?", "", text)) == ["table_name, hotel_id"]
    assert "Scan parquet" not in text


def settings(spark):
    sizes = ("files.maxPartitionBytes", "adaptive.advisoryPartitionSizeInBytes", "adaptive.coalescePartitions.initialPartitionNum")
    return [spark.conf.get(f"spark.sql.{s}", None) for s in sizes]


@pytest.mark.parametrize("files", [4, 16])
def test_fingerprints_are_grouped_in_tasks_of_bounded_bytes(spark, make_table, tmp_path, monkeypatch, files):
    """Four times the rows make four times the tasks, not larger ones; the session's settings come back."""
    empty = make_table("daily_occupancy", [])
    values = {"hotel_id": F.col("id") % 3, "fill_rate": F.rand(7)}
    rows = spark.range(files * 100_000).select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema])
    rows.repartition(files).write.parquet(str(tmp_path / "days"))
    table = spark.read.parquet(str(tmp_path / "days"))
    groups, kept = [], profile.cut_lineage

    def spied(df):
        dealt = table.groupBy("fill_rate").count().groupBy(F.spark_partition_id()).count()
        groups.extend(r["count"] for r in dealt.collect())
        return kept(df)

    monkeypatch.setattr(profile, "cut_lineage", spied)
    monkeypatch.setattr(profile, "TASK_BYTES", 1 << 20)
    before = settings(spark)
    found = profile.data_quality(HotelTables.of({"daily_occupancy": table}), ("daily_occupancy",)).collect()
    assert sum(r["row_count"] for r in found) == files * 100_000
    assert max(groups) < 250_000
    assert settings(spark) == before


@pytest.mark.parametrize("name", ["model_report", "report_fields"])
def test_reports_group_fingerprints_in_small_tasks(spark, monkeypatch, name):
    seen, kept = [], profile.cut_lineage

    def spied(df):
        seen.append(settings(spark)[:2])
        return kept(df)

    monkeypatch.setattr(profile, "cut_lineage", spied)
    before = settings(spark)
    assert entry.queries()[name](spark, TESTDATA).count() > 0
    assert seen == [[str(16 << 20)] * 2] and settings(spark) == before


def test_small_tasks_keep_smaller_sizes(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "8k")
    try:
        with small_tasks(spark, 1, 1 << 20):
            assert (spark.conf.get(key), spark.conf.get("spark.sql.files.maxPartitionBytes")) == ("8192", str(1 << 20))
        assert spark.conf.get(key) == "8k"
    finally:
        spark.conf.unset(key)


def test_hot_session_is_split(no_broadcast, make_table):
    """One session with most of all searches: the join that meets raw searches is split by adaptive execution."""
    spark = no_broadcast
    start = datetime(2024, 1, 1)
    base = make_table("search_log", [{"id": 1, "search_log_session_id": 1, "utc_datetime": start, "conversion": 0.0}])
    hot = spark.range(60_000).select(
        *[
            {
                "id": F.col("id") + 10,
                "search_log_session_id": F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 5000 + 2).cast("long"),
                "utc_datetime": F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)")),
                "conversion": F.when(F.col("id") == 30_000, 1.0).otherwise(0.0),
            }.get(f.name, F.lit(1 if f.name == "hotel_id" else None)).cast(f.dataType).alias(f.name)
            for f in base.schema
        ]
    )
    sessions = spark.range(5002).select(
        F.lit(1).cast("long").alias("hotel_id"), "id", F.concat(F.lit("u"), F.col("id")).alias("uuid")
    )
    t = HotelTables.of({"search_log": hot.repartition(16), "search_log_session": sessions})
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = visits.visits_before_booking(t)
        rows = got.collect()
        final = plan(got)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "SortMergeJoin(skew=true)" in final
    # searches 0, 3, 6, … of the hot session, strictly before number 30,000
    assert [(r["uuid"], r["visits"]) for r in rows] == [("u1", 10_000)]


def test_hot_session_reaches_the_session_join_as_few_rows(make_tables):
    """A third of all bookings in one session: the session join sees one row per lead time and segment."""
    at = datetime(2024, 1, 1)
    t = make_tables(
        search_log=[
            {
                "id": i, "search_log_session_id": 1 if i % 3 == 0 else i, "utc_datetime": at,
                "arrival": at + timedelta(days=i % 4), "adults": 2, "children": 0, "conversion": 1.0,
            }
            for i in range(1, 301)
        ],
        booking_data=[{"search_log_id": i} for i in range(1, 301)],
        search_log_session=[{"id": i, "uuid": f"u{i}", "utm_source": "google", "utm_medium": "cpc"} for i in range(1, 301)],
        search_log_room=[], search_log_room_child=[],
    )
    source = leadtime.lead_time_by_source(t).first()
    segment = leadtime.lead_time_by_segment(t).first()
    assert source["bookings"] == segment["bookings"] == 300 and source["std"] == segment["std"]


@pytest.mark.parametrize("name", ["lead_time_by_source", "visits_summary", "upsell_revenue_tiers", "top_bookers", "daily_features"])
def test_results_do_not_depend_on_the_partitioning(spark, name):
    once = sorted(map(str, entry.queries()[name](spark, TESTDATA).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        again = sorted(map(str, entry.queries()[name](spark, TESTDATA).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert once == again


def test_segments_add_up_to_the_whole(spark):
    t = load_views(spark, TESTDATA)
    by_segment = leadtime.bookings_by_segment(t).agg(F.sum("bookings")).first()[0]
    records = t.booking_data.select("hotel_id", F.col("search_log_id").alias("id")).distinct()
    assert by_segment == records.join(t.search_log, ["hotel_id", "id"], "left_semi").count() < records.count()


def test_shuffles_are_sized_from_the_data(spark):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    try:
        assert size_shuffles(spark, 5 << 40) == 40960
        assert spark.conf.get(key) == "40960"
        assert size_shuffles(spark, 1) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.unset(key)


@pytest.mark.parametrize("analysis", [segments.segment_stats, leadtime.lead_time_by_segment, upsell.upsell_by_segment, rooms.room_choice_by_segment])
def test_a_stored_segment_replaces_the_joins(spark, tmp_path, analysis):
    plain = load_views(spark, TESTDATA)
    with_stored_segment(plain).search_log.write.partitionBy("hotel_id").parquet(str(tmp_path / "search_log"))
    stored = plain.replaced(search_log=store.read_store(spark, str(tmp_path)).search_log)
    assert sorted(map(str, analysis(stored).collect())) == sorted(map(str, analysis(plain).collect()))
    assert "l_returnflag" not in plan(analysis(stored)) and "l_returnflag" in plan(analysis(plain))
