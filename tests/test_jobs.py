import json
import os
import shutil

import numpy as np
import pytest
from conftest import make_wav, manifest_line
from pyspark.sql import functions as F

from clipmill import ExportSpec, SplitPolicy
from clipmill.functions import wav
from clipmill.operators.validate import ManifestError, validate_manifest
from clipmill.plans.adapt import adapt, adapt_binary_endpoint
from clipmill.plans.freeze import freeze_export, save_export
from clipmill.plans.materialize import materialize
from clipmill.schemas import DATASET
from clipmill.sinks.dataset import META_FILE
from clipmill.sources import clips as clip_source
from clipmill.sources.clips import attach_clips, read_clips
from clipmill.sources.dataset import dataset_splits, read_dataset, read_quarantine
from clipmill.sources.export_dir import open_export
from clipmill.sources.manifest import read_manifest
from clipmill.sources.pages import read_pages
from clipmill.streaming.adapt_stream import adapt_stream
from workload import QUERIES, Tables

SIX = [
    ("a1", "end_of_turn", "train"),
    ("a2", "end_of_turn", "train"),
    ("a3", "end_of_turn", "train"),
    ("a4", "continuation", "validation"),
    ("a5", "continuation", "test"),
    ("a6", "end_of_turn", "test"),
]


@pytest.fixture
def six(spark, make_export):
    lines = [manifest_line(*row) for row in SIX]
    clips = {row[0]: make_wav(np.linspace(-0.9, 0.9, 50 + i)) for i, row in enumerate(SIX)}
    return open_export(spark, make_export(lines, clips))


@pytest.mark.parametrize("how", ["auto", "scan", "by_path"])
def test_six_clips_in_three_splits(spark, six, tmp_path, how):
    out = str(tmp_path / "out")
    result = adapt_binary_endpoint(spark, six, out, "zh", how=how)
    assert result.total == 6 and result.split_counts == {"train": 3, "validation": 1, "test": 2}
    assert dataset_splits(spark, out) == ["train", "validation", "test"]

    train = read_dataset(spark, out, "train")
    assert train.columns == DATASET.fieldNames()
    assert train.schema["audio"].dataType.fieldNames() == ["bytes", "path"]
    assert [f.dataType.simpleString() for f in train.schema] == [f.dataType.simpleString() for f in DATASET]
    assert train.count() == 3

    rows = {r.annotation_id: r for r in read_dataset(spark, out).collect()}
    for i, (name, label, split) in enumerate(SIX):
        row = rows[name]
        assert (row.split, row.endpoint_bool, row.language) == (split, int(label == "end_of_turn"), "zh")
        assert row.audio.path == f"clips/{name}.wav" and row.clip_sha256 == f"digest of {name}"
        assert bytes(row.audio.bytes) == wav.canonicalize(make_wav(np.linspace(-0.9, 0.9, 50 + i)))

    meta = json.loads((tmp_path / "out" / META_FILE).read_text())
    assert meta["split_counts"] == {"test": 2, "train": 3, "validation": 1} and meta["language"] == "zh"
    assert "endpoint_bool" in (tmp_path / "out" / "README.md").read_text()
    assert not [n for n in os.listdir(out) if n.startswith("_staging")]


def test_written_columns_are_required(spark, six, tmp_path):
    import pyarrow.parquet as pq

    adapt_binary_endpoint(spark, six, str(tmp_path / "out"), "zh")
    (part, *_) = (tmp_path / "out").glob("runs/whole/*/data/split=train/*.parquet")
    schema = pq.read_schema(part)
    assert not any(schema.field(name).nullable for name in DATASET.fieldNames())
    assert pq.ParquetFile(part).metadata.row_group(0).column(0).compression == "SNAPPY"


def test_empty_split_is_not_written_and_old_one_goes(spark, six, tmp_path):
    out = str(tmp_path / "out")
    adapt_binary_endpoint(spark, six, out, "zh")
    lines = [manifest_line(*row) for row in SIX if row[2] == "train"]
    with open(six.manifest_path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines))
    adapt_binary_endpoint(spark, six, out, "zh")
    assert dataset_splits(spark, out) == ["train"]


@pytest.mark.parametrize("how", ["scan", "by_path"])
def test_corrupt_clip_is_named(spark, make_export, tmp_path, how):
    export = open_export(spark, make_export([manifest_line("bad")], {"bad": b"definitely not a wav"}))
    with pytest.raises(Exception, match="bad.wav") as caught:
        adapt_binary_endpoint(spark, export, str(tmp_path / "out"), "zh", how=how)
    assert "WAV" in str(caught.value)
    left = os.listdir(tmp_path / "out") if (tmp_path / "out").exists() else []
    assert not [name for name in left if not name.startswith(".")]


def test_corrupt_clip_can_be_set_aside(spark, make_export, tmp_path):
    lines = [manifest_line("good"), manifest_line("bad")]
    export = open_export(spark, make_export(lines, {"good": make_wav([0.1] * 9), "bad": b"noise"}))
    out = str(tmp_path / "out")
    result = adapt_binary_endpoint(spark, export, out, "zh", on_error="quarantine")
    assert result.split_counts == {"train": 1}
    assert [r.annotation_id for r in read_dataset(spark, out, "train").collect()] == ["good"]
    (aside,) = read_quarantine(spark, out).collect()
    assert aside.annotation_id == "bad" and "clips/bad.wav" in aside.error
    shutil.copy(os.path.join(export.clips_dir, "good.wav"), os.path.join(export.clips_dir, "bad.wav"))
    assert adapt_binary_endpoint(spark, export, out, "zh").split_counts == {"train": 2}
    assert read_quarantine(spark, out) is None


def test_stream_sets_aside_and_writes_a_card(spark, make_export, tmp_path):
    lines = [manifest_line("good"), manifest_line("bad", split="test")]
    root = make_export(lines, {"good": make_wav([0.1] * 9), "bad": b"noise"})
    out = str(tmp_path / "out")
    (tmp_path / "incoming").mkdir()
    shutil.copy(f"{root}/manifest.jsonl", tmp_path / "incoming" / "first.jsonl")
    adapt_stream(spark, str(tmp_path / "incoming"), f"{root}/clips", out, str(tmp_path / "cp"), "zh", on_error="quarantine").awaitTermination()
    assert [r.annotation_id for r in read_quarantine(spark, out).collect()] == ["bad"]
    meta = json.loads((tmp_path / "out" / "export_meta.json").read_text())
    assert meta["split_counts"] == {"train": 1} and "train: 1 clips" in (tmp_path / "out" / "README.md").read_text()


@pytest.mark.parametrize("how", ["scan", "by_path"])
def test_missing_clip_is_named(spark, make_export, tmp_path, how):
    export = open_export(spark, make_export([manifest_line("here"), manifest_line("gone")], {"here": make_wav([0.0])}))
    with pytest.raises(FileNotFoundError, match="gone.wav"):
        adapt_binary_endpoint(spark, export, str(tmp_path / "out"), "zh", how=how)


@pytest.mark.parametrize(
    "line, message",
    [
        (manifest_line("a", label="speaker_change"), "speaker_change"),
        (manifest_line("a", split="dev"), "dev"),
        ("", "empty"),
    ],
)
def test_rules_are_checked_before_clips_are_read(spark, make_export, tmp_path, line, message):
    export = open_export(spark, make_export([line], {"a": b"x"}))
    with pytest.raises(ManifestError, match=message):
        adapt_binary_endpoint(spark, export, str(tmp_path / "out"), "zh")


def test_unknown_adapter(spark, six, tmp_path):
    with pytest.raises(KeyError):
        adapt(spark, six, str(tmp_path / "out"), "zh", adapter="other")


@pytest.mark.parametrize("how", ["scan", "by_path"])
def test_shared_and_unlisted_clips_and_odd_names(spark, make_export, how):
    lines = [
        manifest_line("x1", clipPath="clips/b 2.wav"),
        manifest_line("x2", clipPath="b 2.wav"),
        manifest_line("x3", clipPath="clips/c%3.wav"),
        manifest_line("x4", clipPath="clips/sub/é.wav"),
    ]
    root = make_export(lines, {"b 2": b"B", "c%3": b"C", "extra": b"E"})
    os.mkdir(f"{root}/clips/sub")
    with open(f"{root}/clips/sub/é.wav", "wb") as f:
        f.write(b"S")
    export = open_export(spark, root)
    manifest = export.manifest()
    rows = attach_clips(spark, manifest, export.clips_dir, validate_manifest(manifest), how).collect()
    assert {r.annotation_id: bytes(r.content) for r in rows} == {"x1": b"B", "x2": b"B", "x3": b"C", "x4": b"S"}


def test_scan_broadcasts_only_small_manifests_without_hot_clips(spark, six, monkeypatch):
    manifest = six.manifest()
    profile = validate_manifest(manifest)
    assert clip_source.scan_may_broadcast(manifest, profile)
    monkeypatch.setattr(clip_source, "BROADCAST_BYTES", 10)
    assert not clip_source.scan_may_broadcast(manifest, profile)
    assert attach_clips(spark, manifest, six.clips_dir, profile, "scan").count() == 6
    monkeypatch.undo()
    monkeypatch.setattr(clip_source, "SHARED_CLIP_ROWS", 3)
    hot = manifest.withColumn("clip_path", F.lit("clips/a1.wav"))
    assert not clip_source.scan_may_broadcast(hot, profile)
    for how in ("scan", "by_path"):
        assert attach_clips(spark, hot, six.clips_dir, profile, how).count() == 6


def test_unknown_filesystems_are_scanned(spark, six, monkeypatch):
    monkeypatch.setattr(clip_source.files_io, "can_open", lambda root: False)
    manifest = six.manifest()
    rows = attach_clips(spark, manifest, six.clips_dir, validate_manifest(manifest))
    assert "BroadcastHashJoin" in rows._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="guess"):
        attach_clips(spark, manifest, six.clips_dir, validate_manifest(manifest), "guess")


def test_scan_does_not_shuffle_clip_bytes(spark, six):
    manifest = six.manifest()
    rows = attach_clips(spark, manifest, six.clips_dir, validate_manifest(manifest), "scan")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    paths = read_clips(spark, six.clips_dir).select("rel")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in paths


def exports_table(spark, status="ready"):
    return spark.createDataFrame([("e1", status)], "id string, status string")


def test_materialize_resumes(spark, six, tmp_path):
    out = str(tmp_path / "copy")
    manifest = six.manifest()
    first = materialize(spark, exports_table(spark), "e1", manifest, six.clips_dir, out)
    assert (first.total, first.skipped, first.downloaded) == (6, 0, 6) and first.bytes > 0
    # A file cut short counts as absent.
    short = tmp_path / "copy" / "clips" / "a2.wav"
    short.write_bytes(short.read_bytes()[:10])
    os.remove(tmp_path / "copy" / "clips" / "a5.wav")
    second = materialize(spark, exports_table(spark), "e1", manifest, six.clips_dir, out)
    assert (second.total, second.skipped, second.downloaded) == (6, 4, 2)
    third = materialize(spark, exports_table(spark), "e1", manifest, six.clips_dir, out, force=True)
    assert (third.skipped, third.downloaded, third.bytes) == (0, 6, first.bytes)
    for name, *_ in SIX:
        copied = (tmp_path / "copy" / "clips" / f"{name}.wav").read_bytes()
        assert copied == open(f"{six.clips_dir}/{name}.wav", "rb").read()
    assert sorted(os.listdir(tmp_path / "copy" / "clips")) == [f"a{i}.wav" for i in range(1, 7)]
    assert open_export(spark, out).manifest().count() == 6


def test_materialize_needs_a_ready_export_and_all_sources(spark, six, tmp_path):
    with pytest.raises(ValueError, match="pending"):
        materialize(spark, exports_table(spark, "pending"), "e1", six.manifest(), six.clips_dir, str(tmp_path / "c"))
    os.remove(f"{six.clips_dir}/a3.wav")
    with pytest.raises(FileNotFoundError, match="a3.wav"):
        materialize(spark, exports_table(spark), "e1", six.manifest(), six.clips_dir, str(tmp_path / "c"))


def test_stream_takes_each_manifest_once(spark, make_export, tmp_path):
    names = ["a1", "a2", "a3"]
    root = make_export([], {n: make_wav([0.2] * 20) for n in names})
    incoming, out, checkpoint = tmp_path / "incoming", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    incoming.mkdir()

    def run():
        adapt_stream(spark, str(incoming), f"{root}/clips", out, checkpoint, "zh").awaitTermination()
        return sorted(r.annotation_id for r in read_dataset(spark, out).collect())

    (incoming / "one.jsonl").write_text(manifest_line("a1") + "\n")
    assert run() == ["a1"]
    assert run() == ["a1"]
    (incoming / "two.jsonl").write_text(manifest_line("a2") + "\n" + manifest_line("a3", split="test") + "\n")
    assert run() == names
    assert read_dataset(spark, out, "train").columns == DATASET.fieldNames()
    (incoming / "three.jsonl").write_text("\n")
    assert run() == names
    (incoming / "four.jsonl").write_text("broken\n")
    with pytest.raises(Exception, match="invalid manifest line"):
        run()


def test_freeze_export(spark):
    annotations = spark.range(300).select(
        F.col("id").cast("string").alias("id"),
        (F.col("id") % 10).cast("string").alias("file_id"),
        F.lit("end_of_turn").alias("label_key"),
        F.lit(1).cast("bigint").alias("label_value"),
        F.lit(0.5).alias("start_sec"),
        F.lit(2.0).alias("end_sec"),
        F.when(F.col("id") % 2 == 0, F.lit("approved")).alias("review_status"),
        F.lit(3).cast("bigint").alias("created_by"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"),
        F.lit("ls1").alias("label_set_id"),
        F.lit("c").alias("clip_sha256"),
        F.lit(16000).alias("clip_sample_rate"),
        F.lit("s").alias("source_file_sha256"),
    )
    files = spark.createDataFrame(
        [(str(i), "p1" if i < 8 else "p2", "t" if i == 4 else None) for i in range(10)],
        "id string, project_id string, test_reserved_at string",
    )
    projects = spark.createDataFrame([("p1", "ls1")], "id string, active_label_set_id string")
    spec = ExportSpec("p1", "n", use_reserved_test_files=True, split=SplitPolicy("by_source_file", 1, (0.5, 0.5, 0.0)))
    frozen = freeze_export(annotations, files, projects, spec, "e1", 9, "2024-01-01T00:00:00Z")
    rows = frozen.manifest.collect()
    assert len(rows) == 120 and {r.source_file_id for r in rows} == {"0", "2", "4", "6"}
    assert all((r.split == "test") == (r.source_file_id == "4") for r in rows)
    assert rows[0].clip_path == f"clips/{rows[0].annotation_id}.wav" and rows[0].clip_duration_sec == 1.5
    record = frozen.export.head()
    assert (record.status, record.clip_count, record.total_bytes) == ("ready", 120, None)
    assert json.loads(record.filter)["useReservedTestFiles"] is True and json.loads(record.split_policy)["seed"] == 1
    assert [r.file_id for r in frozen.reserved_files.collect()] == ["4"]
    exact = freeze_export(
        annotations, files, projects, ExportSpec("p1", "n"), "e2", 9, "2024-01-01T00:00:00Z", exact=True
    )
    counts = {r["split"]: r["count"] for r in exact.manifest.groupBy("split").count().collect()}
    assert counts == {"train": 96, "validation": 12, "test": 12}


def test_saved_export_is_consistent(spark, tmp_path):
    annotations = spark.createDataFrame(
        [("a1", "f1", "end_of_turn", 1, 0.0, 1.0, "approved", 7, "ls1", "c", 16000, "s")],
        "id string, file_id string, label_key string, label_value bigint, start_sec double, end_sec double, "
        "review_status string, created_by bigint, label_set_id string, clip_sha256 string, clip_sample_rate int, "
        "source_file_sha256 string",
    )
    files = spark.createDataFrame([("f1", "p1", "t")], "id string, project_id string, test_reserved_at string")
    projects = spark.createDataFrame([("p1", "ls1")], "id string, active_label_set_id string")
    out = tmp_path / "saved"
    spec = ExportSpec("p1", "n", use_reserved_test_files=True, split=SplitPolicy(ratios=(0.9, 0.1, 0.0)))
    record = save_export(annotations, files, projects, spec, "e1", str(out), 1, "2024-01-01T00:00:00Z")
    saved = json.loads((out / "export.json").read_text())
    assert saved["manifestSha256"] == record.manifest_sha256 and saved["clipCount"] == 1
    assert saved["filter"]["labelSetId"] == "ls1" and saved["splitPolicy"]["ratios"] == [0.9, 0.1, 0.0]
    (row,) = read_manifest(spark, str(out / "manifest.jsonl")).collect()
    assert (row.annotation_id, row.split) == ("a1", "test")
    assert [tuple(r) for r in spark.read.parquet(str(out / "reserved_files.parquet")).collect()] == [("f1", "e1")]


def test_read_pages(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    item = {"id": "e1", "projectId": "p", "name": "n } {", "status": "ready", "filter": {"labelSetId": "x"},
            "r2Prefix": "r", "createdBy": 1, "createdAt": "t", "canDelete": True, "unknown": 1}
    page = {"exports": [item, item | {"id": "e2"}], "page": 1, "pageSize": 20, "total": 3, "totalPages": 1}
    # Two printed pages in one file, one in another.
    both = json.dumps(page, indent=2) + "\n" + json.dumps(page | {"exports": [item | {"id": "e3"}]}) + "\n"
    (folder / "1.json").write_text(both)
    (folder / "2.json").write_text(json.dumps(page | {"exports": []}, indent=2))
    rows = {r.id: r for r in read_pages(spark, str(folder), "exports").collect()}
    assert set(rows) == {"e1", "e2", "e3"}
    first = rows["e1"]
    assert first.name == "n } {" and json.loads(first.filter) == {"labelSetId": "x"}
    assert first.can_delete is True and first.can_download is False and first.clip_count is None

    (folder / "3.json").write_text(json.dumps({"exports": [{"id": "e4"}]}))
    with pytest.raises(Exception, match="without"):
        read_pages(spark, str(folder), "exports").collect()
    with pytest.raises(ValueError, match="users"):
        read_pages(spark, str(folder), "users")


@pytest.mark.parametrize("text", ['{"files": 5}', "{broken", '{"page": 1}'])
def test_bad_pages_fail(spark, tmp_path, text):
    (tmp_path / "p.json").write_text(text)
    with pytest.raises(Exception):
        read_pages(spark, str(tmp_path / "p.json"), "files").collect()


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("block", [64, 700, 1 << 20])
def test_pages_of_one_file_span_tasks(spark, conf, tmp_path, indent, block):
    item = {"projectId": "p", "name": 'n }\\n{ "}', "status": "ready", "filter": {"labelSetId": "é"},
            "r2Prefix": "r", "createdBy": 1, "createdAt": "t"}
    pages, ids = [], []
    for n in range(12):
        some = [f"e{n}-{i}" for i in range(n % 4)]
        pages.append(json.dumps({"exports": [item | {"id": i} for i in some], "page": n}, indent=indent))
        ids += some
    (tmp_path / "pages.json").write_text("\n \r\n".join(pages) + "\n\n")
    (tmp_path / "more.json").write_text(pages[3])
    conf("spark.sql.files.maxPartitionBytes", str(block))
    conf("spark.sql.files.openCostInBytes", "0")
    rows = read_pages(spark, str(tmp_path), "exports")
    assert sorted(r.id for r in rows.collect()) == sorted([*ids, "e3-0", "e3-1", "e3-2"])
    tasks = spark.read.option("lineSep", "\n").text(str(tmp_path / "pages.json")).rdd.getNumPartitions()
    assert tasks > 1 or block > 700


def test_pages_of_an_empty_file(spark, tmp_path):
    (tmp_path / "p.json").write_text("\n")
    assert read_pages(spark, str(tmp_path), "files").count() == 0


def test_listing_as_jobs(spark, tmp_path):
    root = tmp_path / "clips"
    wanted = {}
    for folder in ("", "a", "a/b", "c é"):
        (root / folder).mkdir(parents=True, exist_ok=True)
        for i in range(3):
            (root / folder / f"{i} x.wav").write_bytes(b"." * (i + 1 + len(folder)))
            wanted[f"{folder}/{i} x.wav".lstrip("/")] = i + 1 + len(folder)
        (root / folder / "_0.wav.part").write_bytes(b"half")
    (root / "empty").mkdir()
    found = clip_source.list_clips(spark, str(root), str(tmp_path / "listing"))
    assert {r.rel: r.length for r in found.collect()} == wanted
    assert {r.rel: r.length for r in read_clips(spark, str(root)).select("rel", "length").collect()} == wanted
    assert clip_source.list_clips(spark, str(tmp_path / "none"), str(tmp_path / "nothing")).count() == 0


def test_a_finished_export_resumes_from_its_ledger(spark, six, tmp_path, monkeypatch):
    from clipmill.plans import materialize as plan

    out = str(tmp_path / "copy")
    manifest = six.manifest()
    materialize(spark, exports_table(spark), "e1", manifest, six.clips_dir, out)
    looks = []
    lengths = plan.clip_lengths
    monkeypatch.setattr(plan, "clip_lengths", lambda rows, root: looks.append(rows.count()) or lengths(rows, root))
    again = materialize(spark, exports_table(spark), "e1", manifest, six.clips_dir, out)
    assert (again.total, again.skipped, again.bytes) == (6, 6, 0) and not looks
    # One clip got another digest, one is gone, one is new: only these are looked at.
    os.remove(tmp_path / "copy" / "clips" / "a5.wav")
    with open(f"{six.clips_dir}/a2.wav", "ab") as clip:
        clip.write(b"longer")
    shutil.copy(f"{six.clips_dir}/a1.wav", f"{six.clips_dir}/a7.wav")
    new = manifest.where("annotation_id = 'a1'").withColumn("clip_path", F.lit("clips/a7.wav"))
    digest = F.when(F.col("annotation_id") == "a2", F.lit("other")).otherwise(F.col("clip_sha256"))
    changed = manifest.withColumn("clip_sha256", digest).unionByName(new).unionByName(new)
    third = materialize(spark, exports_table(spark), "e1", changed, six.clips_dir, out)
    assert (third.total, third.skipped, third.downloaded) == (8, 4, 4) and looks == [3, 3]
    assert (tmp_path / "copy" / "clips" / "a2.wav").read_bytes() == open(f"{six.clips_dir}/a2.wav", "rb").read()
    assert materialize(spark, exports_table(spark), "e1", changed, six.clips_dir, out).skipped == 8 and len(looks) == 2


def test_a_run_that_died_leaves_no_entry(spark, six, tmp_path):
    # Its copies are found by a look at them and enter the ledger.
    out = tmp_path / "copy"
    (out / "clips").mkdir(parents=True)
    shutil.copy(f"{six.clips_dir}/a1.wav", out / "clips" / "a1.wav")
    first = materialize(spark, exports_table(spark), "e1", six.manifest(), six.clips_dir, str(out))
    assert (first.skipped, first.downloaded) == (1, 5)
    entries = spark.read.parquet(str(out / "copied")).collect()
    assert sorted((r.rel, r.copied) for r in entries) == [("a1.wav", False), *((f"a{i}.wav", True) for i in range(2, 7))]


def test_a_task_of_materialize_again_holds_one_python_worker(spark, tmp_path, monkeypatch):
    vectors = [(i, [i / 100 - j / 64 for j in range(64)], i % 10) for i in range(60)]
    orders = [(1, 1, "F", "2024-01-01", "1-URGENT")]
    vectors = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    vectors.write.parquet(str(tmp_path / "embeddings.parquet"))
    orders = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate string, o_orderpriority string")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    kind, below = type(orders), []

    def looked_at(self, *args, map_rows=kind.mapInArrow, **kwargs):
        plan = self._jdf.queryExecution().executedPlan().toString()
        below.append("MapInArrow" in plan.split("Exchange")[0])  # a Python step of the same stage
        return map_rows(self, *args, **kwargs)

    monkeypatch.setattr(kind, "mapInArrow", looked_at)
    table = QUERIES["materialize_again"](Tables(spark, str(tmp_path)))
    assert sorted(map(tuple, table.collect())) == [(1, 60, 0, 60), (2, 60, 30, 30), (3, 60, 60, 0)]
    assert len(below) > 6 and not any(below)
    assert table.dtypes == [("run", "int"), ("total", "bigint"), ("skipped", "bigint"), ("downloaded", "bigint")]
    assert "PythonRDD" not in table._jdf.queryExecution().toRdd().toDebugString()
