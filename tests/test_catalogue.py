import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from clipmill import ExportSpec
from clipmill.operators import aggregates, changes, filters, joins, paging
from clipmill.plans import listings
from clipmill.sources.pages import read_pages


@pytest.fixture
def annotations(spark):
    rows = [
        ("a1", "f1", "end_of_turn", "approved", 1, 0.0, 1.5),
        ("a2", "f1", "continuation", None, 2, 1.0, 2.0),
        ("a3", "f2", "end_of_turn", "unreviewed", 1, 0.5, 0.75),
        ("a4", "f9", "other", "rejected", 3, 0.0, 0.1),
    ]
    schema = "id string, file_id string, label_key string, review_status string, created_by bigint, start_sec double, end_sec double"
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("created_at", F.lit("2024-01-05 10:00:00").cast("timestamp_ntz"))


@pytest.fixture
def files(spark):
    rows = [("f1", "p1", "Call_100%.wav", None), ("f2", "p1", "call_2.wav", "2024-01-01T00:00:00Z"), ("f3", "p2", "x.wav", "t")]
    return spark.createDataFrame(rows, "id string, project_id string, name string, test_reserved_at string")


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_annotation_filters(annotations):
    assert ids(filters.filter_annotations(annotations)) == ["a1", "a2", "a3", "a4"]
    assert ids(filters.filter_annotations(annotations, review_status="unreviewed")) == ["a2", "a3"]
    assert ids(filters.filter_annotations(annotations, label="end_of_turn", created_by=1, file_id="f2")) == ["a3"]


def test_export_filter_defaults_to_approved(annotations):
    assert ids(filters.filter_export(annotations, ExportSpec("p", "n"))) == ["a1"]
    both = ExportSpec("p", "n", review_statuses=("approved", "unreviewed"), labeller_ids=(1,))
    assert ids(filters.filter_export(annotations, both)) == ["a1", "a3"]


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "string"])
def test_time_bounds_are_inclusive_instants(annotations, kind):
    if kind == "string":
        df = annotations.withColumn("created_at", F.lit("2024-01-05T10:00:00Z"))
    else:
        df = annotations.withColumn("created_at", F.col("created_at").cast(kind))

    def found(**bounds):
        return len(ids(filters.filter_export(df, ExportSpec("p", "n", **bounds))))

    assert found(created_at_from="2024-01-05T10:00:00Z", created_at_to="2024-01-05T12:00:00+02:00") == 1
    assert found(created_at_from="2024-01-05T10:00:01Z") == 0
    assert found(created_at_to="2024-01-05T09:59:59Z") == 0


def test_file_filter_takes_wildcards_literally(files):
    assert ids(filters.filter_files(files, q="CALL_")) == ["f1", "f2"]
    assert ids(filters.filter_files(files, q="%")) == ["f1"]
    assert ids(filters.filter_files(files, test_reserved=True)) == ["f2", "f3"]
    assert ids(filters.filter_files(files, q="call", test_reserved=False)) == ["f1"]


def test_require_ready(spark):
    exports = spark.createDataFrame([("e1", "ready"), ("e2", "pending")], "id string, status string")
    assert filters.require_ready(exports, "e1").count() == 1
    with pytest.raises(ValueError, match="pending"):
        filters.require_ready(exports, "e2")
    with pytest.raises(LookupError, match="e3"):
        filters.require_ready(exports, "e3")


def test_resolve_label_set(spark):
    projects = spark.createDataFrame([("p1", "ls1"), ("p2", None)], "id string, active_label_set_id string")
    assert joins.resolve_label_set(projects, "p1") == "ls1"
    assert joins.resolve_label_set(projects, "p2", "mine") == "mine"
    with pytest.raises(ValueError, match="no active label set"):
        joins.resolve_label_set(projects, "p2")
    with pytest.raises(LookupError):
        joins.resolve_label_set(projects, "p3")


def test_mark_reserved(annotations, files):
    marked = {r.id: r.reserved for r in joins.mark_reserved(annotations, files).collect()}
    assert marked == {"a1": False, "a2": False, "a3": True, "a4": False}


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_lookup_equals_plain_join_with_a_hot_key(spark, conf, monkeypatch, how):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    # One key holds a third of the rows, another third has none; the rest are not hot.
    monkeypatch.setattr(joins, "HOT_SHARE", 0.05)
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.col("id") % 50).cast("string")
    rows = spark.range(3000).select("id", key.alias("k"))
    lookup = spark.range(5, 30).select(F.col("id").cast("string").alias("k"), (F.col("id") * 2).alias("v"))
    salted = joins.spread_lookup(rows, lookup, "k", "id", how)
    plain = rows.join(lookup, "k", how)
    assert salted.columns == plain.columns
    assert sorted(map(tuple, salted.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_rows_of_a_hot_key_meet_in_several_tasks(spark, conf, monkeypatch):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.enabled", "false")
    conf("spark.sql.shuffle.partitions", "8")
    monkeypatch.setattr(joins, "HOT_SHARE", 0.05)
    rows = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"))
    lookup = spark.range(4000).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    joined = joins.spread_lookup(rows, lookup, "k", "id").withColumn("task", F.spark_partition_id())
    per_task = [r["count"] for r in joined.where("k = 7").groupBy("task").count().collect()]
    assert sum(per_task) == 2001 and len(per_task) > 3 and max(per_task) < 1000


def test_small_lookup_is_not_salted(spark):
    rows = spark.range(10).withColumn("k", F.col("id").cast("string"))
    lookup = spark.range(3).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v"))
    plan = joins.spread_lookup(rows, lookup, "k", "id")._jdf.queryExecution().toString()
    assert "_salt" not in plan


def test_plan_fetch(spark):
    manifest = spark.createDataFrame([("a",), ("b",), ("c",)], "annotation_id string")
    present = spark.createDataFrame([("b",), ("x",)], "annotation_id string")

    def names(df):
        return sorted(r[0] for r in df.collect())

    pending, skipped = joins.plan_fetch(manifest, present)
    assert (names(pending), names(skipped)) == (["a", "c"], ["b"])
    pending, skipped = joins.plan_fetch(manifest, present, force=True)
    assert (names(pending), names(skipped)) == (["a", "b", "c"], [])


def test_reservation_summary(annotations, files):
    assert tuple(aggregates.reservation_summary(files, annotations, "p1").head()) == (1, 1, 0.25)
    assert tuple(aggregates.reservation_summary(files, annotations, "p2").head()) == (1, 0, 0.0)
    assert tuple(aggregates.reservation_summary(files, annotations, "p3").head()) == (0, 0, 0.0)


def test_annotation_counts(annotations, files):
    counts = {r.id: r.annotation_count for r in aggregates.annotation_counts(files, annotations).collect()}
    assert counts == {"f1": 2, "f2": 1, "f3": 0}


def test_page_info(spark):
    df = spark.range(41)
    assert tuple(aggregates.page_info(df, 1, 20).head()) == (1, 20, 41, 3, 2)
    assert tuple(aggregates.page_info(df, 3, 20).head()) == (3, 20, 41, 3, None)
    assert tuple(aggregates.page_info(df.limit(0)).head()) == (1, 20, 0, 0, None)


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 7).cast("string").alias("x"))

    def digest(rows):
        return aggregates.manifest_fingerprint(rows, ["id", "x"]).head()

    base = digest(df)
    assert base.clip_count == 500 and len(base.manifest_sha256) == 64
    for n in (1, 3, 17):
        assert digest(df.orderBy(F.desc("x")).repartition(n)) == base
    assert digest(df.union(df.limit(1))) != base
    assert digest(df.withColumn("x", F.when(F.col("id") == 9, F.lit("!")).otherwise(F.col("x")))) != base
    assert digest(df.limit(0)).clip_count == 0


def test_paging(spark, tmp_path):
    df = spark.createDataFrame([(f"i{n:02d}", n // 4) for n in range(23)], "id string, k int").repartition(5)

    def names(page):
        return [r.id for r in page.collect()]

    everything = [f"i{n:02d}" for n in range(23)]
    assert names(paging.page(df, 2, 10, ["k"])) == everything[10:20]
    assert names(paging.page(df, 4, 10, ["k"])) == []
    walked, last = [], None
    while rows := paging.page_after(df, last, 5, ["k"]).collect():
        walked += [r.id for r in rows]
        last = rows[-1].asDict()
    assert walked == everything
    with pytest.raises(ValueError):
        paging.page(df, 0)
    numbered = paging.number_rows(df, str(tmp_path / "numbered"), ["k"])
    assert names(paging.numbered_page(numbered, 1, 8)) == everything[:8]
    assert names(paging.numbered_page(numbered, 2, 10)) == everything[10:20]
    assert names(paging.numbered_page(numbered, 3, 10)) == everything[20:]
    assert names(paging.numbered_page(numbered, 9, 10)) == []


@pytest.mark.parametrize("order", [["k"], ["-k"], ["k", "-j"], ["-j", "k"], ["-id"]])
def test_walks_with_null_keys_are_complete(spark, order):
    rows = [(f"i{n:02d}", None if n % 3 == 0 else n % 4, None if n % 5 == 1 else n % 2) for n in range(24)]
    df = spark.createDataFrame(rows, "id string, k int, j int").repartition(4)
    walked, last = [], None
    while found := paging.page_after(df, last, 5, order).collect():
        walked += [r.id for r in found]
        last = found[-1].asDict()
    assert walked == [r.id for r in paging.page(df, 1, 24, order).collect()] and len(walked) == 24


def test_page_envelopes_read_back(spark, files, tmp_path):
    for number in (1, 2, 3):
        rows = files.drop("project_id").withColumn("duration_sec", F.lit(1.5)).withColumn("annotation_count", F.lit(2))
        printed = paging.page_envelope(rows, "files", number, 2, ["name"])
        body = json.loads(printed.head().json)
        assert (body["page"], body["pageSize"], body["total"], body["totalPages"]) == (number, 2, 3, 2)
        assert [i["id"] for i in body["files"]] == {1: ["f1", "f2"], 2: ["f3"], 3: []}[number]
        printed.write.mode("append").text(str(tmp_path / "pages"))
    found = {r.id: r for r in read_pages(spark, str(tmp_path / "pages"), "files").collect()}
    assert set(found) == {"f1", "f2", "f3"} and found["f1"].test_reserved_at is None
    whole = json.loads(paging.page_envelope(files, "files", 1, 50_000).head().json)
    assert [len(whole["files"]), whole["pageSize"]] == [3, 50_000]


def test_listings_stay_within_a_project(spark, annotations, files):
    transcripts = spark.createDataFrame([("a1", "  hello  "), ("a2", " ")], "id string, asr_text string")
    marked = annotations.withColumn("label_value", F.lit(1))
    rows = listings.list_annotations(marked, files.drop("duration_sec"), transcripts, "p1").collect()
    assert [(r.id, r.file_text, r.transcript_text) for r in sorted(rows)] == [
        ("a1", "Call_100%.wav", "hello"),
        ("a2", "Call_100%.wav", None),
        ("a3", "call_2.wav", None),
    ]
    timed = files.withColumn("duration_sec", F.lit(2.25))
    rows = {r.id: r for r in listings.list_files(timed, annotations, "p1").collect()}
    assert set(rows) == {"f1", "f2"} and rows["f1"].annotation_count == 2 and rows["f1"].duration_text == "2.2s"
    assert rows["f2"].test_text == "reserved" and rows["f1"].test_text == "—"


def test_reservations_are_idempotent(files):
    changed, outcomes = changes.reserve_files(files, ["f1", "f2", "f1", "nope"], "now")
    assert {r.id: r.test_reserved_at for r in changed.collect()} == {"f1": "now", "f2": "2024-01-01T00:00:00Z", "f3": "t"}
    assert {r.id: r.status for r in outcomes.collect()} == {"f1": "ok", "f2": "ok", "nope": "not_found"}
    with pytest.raises(LookupError, match="nope"):
        changes.require_all_ok(outcomes)
    again, _ = changes.reserve_files(changed, ["f1"], "later")
    assert sorted(again.collect()) == sorted(changed.collect())

    cleared, outcomes = changes.unreserve_files(changed, ["f2", "f3"])
    assert {r.id: r.test_reserved_at for r in cleared.collect()} == {"f1": "now", "f2": None, "f3": None}
    changes.require_all_ok(outcomes)


def test_deleting_exports(spark):
    exports = spark.createDataFrame([("e1",), ("e2",)], "id string")
    at = F.lit("2024-03-01 00:00:00").cast("timestamp")
    with pytest.raises(PermissionError):
        changes.soft_delete_exports(exports, ["e1"], at)
    gone = changes.soft_delete_exports(exports, ["e1"], at, confirm=True)
    assert {r.id: r.deleted_at for r in gone.collect()} == {"e1": datetime(2024, 3, 1), "e2": None}

    def due(now):
        return ids(changes.purge_candidates(gone, F.lit(now).cast("timestamp")))

    assert due("2024-03-07 23:59:59") == [] and due("2024-03-08 00:00:00") == ["e1"]


def test_times_without_a_zone_are_utc_in_any_session(spark, conf):
    conf("spark.sql.session.timeZone", "Asia/Tokyo")
    times = ["2024-01-05T10:00:00", "2024-01-05T10:00:00Z", "2024-01-05T19:00:00+09:00", "2024-01-05 10:00:00", "2024-01-05", None]
    df = spark.createDataFrame([(str(i), t, "approved") for i, t in enumerate(times)], "id string, created_at string, review_status string")
    at = "2024-01-05T10:00:00"
    spec = ExportSpec("p", "n", created_at_from=at, created_at_to=at)
    assert ids(filters.filter_export(df, spec)) == ["0", "1", "2", "3"]
    day = ExportSpec("p", "n", created_at_from="2024-01-05", created_at_to="2024-01-05")
    assert ids(filters.filter_export(df, day)) == ["4"]


def test_descriptions_keep_their_spaces(spark):
    texts = ["  spaced out ", " \t", "", None]
    details = spark.createDataFrame([(json.dumps({"id": str(i), "description": t}),) for i, t in enumerate(texts)], "detail string")
    shown = {r.id: r.description for r in listings.show_projects(details).collect()}
    assert shown == {"0": "  spaced out ", "1": None, "2": None, "3": None}
    plan = listings.show_projects(details)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") <= 1
