import json

import pytest
from conftest import manifest_line

from clipmill.operators.validate import ManifestError, manifest_violations, validate_manifest
from clipmill.schemas import MANIFEST
from clipmill.sinks.manifest import write_manifest
from clipmill.sources.export_dir import open_export
from clipmill.sources.manifest import bad_lines, read_manifest


@pytest.fixture
def write(tmp_path):
    def put(*lines, end="\n"):
        path = tmp_path / "manifest.jsonl"
        path.write_text(end.join(lines) + end, encoding="utf-8")
        return str(path)

    return put


def test_reads_records_and_skips_blank_lines(spark, write):
    path = write(manifest_line("a1"), "", "   \t", "  " + manifest_line("a2", split="test") + "  \r")
    rows = {r.annotation_id: r for r in read_manifest(spark, path).collect()}
    assert set(rows) == {"a1", "a2"}
    assert rows["a2"].split == "test" and rows["a1"].clip_duration_sec == 2.25
    assert read_manifest(spark, path).columns == MANIFEST.fieldNames()


def test_review_status_may_be_null_or_missing(spark, write):
    path = write(manifest_line("a1", reviewStatus=None), manifest_line("a2", reviewStatus=...), manifest_line("a3"))
    found = {r.annotation_id: r.review_status for r in read_manifest(spark, path).collect()}
    assert found == {"a1": None, "a2": None, "a3": "approved"}


def test_integers_stand_for_seconds(spark, write):
    assert read_manifest(spark, write(manifest_line("a1", clipDurationSec=2))).head().clip_duration_sec == 2.0


@pytest.mark.parametrize(
    "line, reason",
    [
        ("{not json", "not valid JSON"),
        ("[" + manifest_line("a") + "]", "not a JSON object"),
        ('"text"', "not a JSON object"),
        (manifest_line("a", annotationId=5), "annotationId has the wrong type"),
        (manifest_line("a", labelValue="7"), "labelValue has the wrong type"),
        (manifest_line("a", clipSampleRate=16000.5), "clipSampleRate has the wrong type"),
        (manifest_line("a", clipSampleRate=2**40), "clipSampleRate is out of range"),
        (manifest_line("a", reviewStatus=1), "reviewStatus has the wrong type"),
        (manifest_line("a", split=None), "split is missing"),
        (manifest_line("a", labellerId=...), "labellerId is missing"),
        (manifest_line("a")[:-1] + ',"split":"test"}', "not valid JSON"),
    ],
)
def test_bad_lines_are_named(spark, write, line, reason):
    path = write(manifest_line("ok"), line)
    with pytest.raises(Exception, match="invalid manifest line") as caught:
        read_manifest(spark, path).count()
    assert reason in str(caught.value) and "manifest.jsonl" in str(caught.value)
    (bad,) = bad_lines(spark, path).collect()
    assert bad.line == line and reason in bad.problem


def test_validation(spark, write):
    profile = validate_manifest(read_manifest(spark, write(manifest_line("a"), manifest_line("b", split="test"))))
    assert profile.total == 2 and profile.split_counts == {"train": 1, "test": 1} and profile.text_bytes > 0


@pytest.mark.parametrize(
    "lines, message",
    [
        ([], "manifest is empty"),
        ([manifest_line("a", split="training")], "unknown split.*'training'"),
        ([manifest_line("a"), manifest_line("b", label="speaker_change")], "unknown label.*'speaker_change'"),
    ],
)
def test_broken_rules_name_the_value(spark, write, lines, message):
    with pytest.raises(ManifestError, match=message):
        validate_manifest(read_manifest(spark, write(*lines)))


def test_violation_table(spark):
    row = dict.fromkeys(MANIFEST.fieldNames())
    rows = [row | {"annotation_id": "a", "split": "dev", "label_key": "end_of_turn"}, row | {"split": "train"}]
    df = spark.createDataFrame([tuple(r[c] for c in row) for r in rows], _nullable(MANIFEST))
    found = {r["rule"]: (r.violations, r.sample) for r in manifest_violations(df).collect()}
    assert found["unknown split"] == (1, "dev")
    assert found["annotation_id is missing"] == (1, "annotation_id")
    assert found["label_key is missing"][0] == 1 and found["split is missing"][0] == 0


def _nullable(schema):
    from pyspark.sql import types as T

    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def test_written_manifest_reads_back(spark, write, tmp_path):
    rows = read_manifest(spark, write(manifest_line("a", reviewStatus=None), manifest_line("b")))
    path = write_manifest(rows, str(tmp_path / "out"))
    assert sorted(read_manifest(spark, path).collect()) == sorted(rows.collect())
    first = json.loads(spark.read.text(path).orderBy("value").head()[0])
    assert first["annotationId"] == "a" and first["reviewStatus"] is None


def test_open_export(spark, make_export, tmp_path):
    root = make_export([manifest_line("a")], {})
    by_dir = open_export(spark, root)
    assert by_dir.manifest_path == f"{root}/manifest.jsonl" and by_dir.manifest().count() == 1
    both = open_export(spark, manifest=f"{root}/manifest.jsonl", clips_dir=f"{root}/clips")
    assert (both.manifest_path, both.clips_dir) == (by_dir.manifest_path, by_dir.clips_dir)
    # The directory wins over the single paths.
    assert open_export(spark, root, "/nowhere", "/nowhere") == by_dir
    with pytest.raises(FileNotFoundError, match="manifest"):
        open_export(spark, str(tmp_path / "nothing"))
    with pytest.raises(FileNotFoundError, match="clips"):
        open_export(spark, manifest=f"{root}/manifest.jsonl", clips_dir=str(tmp_path / "no-clips"))
    with pytest.raises(ValueError, match="clips_dir"):
        open_export(spark, manifest=f"{root}/manifest.jsonl")
