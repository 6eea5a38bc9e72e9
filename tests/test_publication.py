import json
import os
import random

import numpy as np
import pytest
from conftest import make_wav, manifest_line
from pyspark.sql import functions as F

from clipmill import publication, storage
from clipmill.operators.validate import ManifestError, validate_manifest
from clipmill.plans import adapt as adapt_plan
from clipmill.plans.adapt import adapt_binary_endpoint, binary_endpoint, publish_rows
from clipmill.sources.dataset import dataset_splits, read_dataset, read_quarantine
from clipmill.sources.export_dir import open_export
from clipmill.sources.manifest import bad_lines, staged_manifest
from clipmill.streaming.adapt_stream import adapt_stream


class Killed(BaseException):
    """Not an Exception: nothing tidies up after it."""


@pytest.fixture
def killer(monkeypatch):
    """Let every change to the storage after the first ``n`` die, before or after it took place."""
    state = {"left": None, "after": False, "steps": 0}
    for name in ("remove", "rename", "write_bytes", "write_text", "write_new"):

        def step(*args, _do=getattr(storage, name), **kwargs):
            state["steps"] += 1
            if state["left"] == 0 and not state["after"]:
                raise Killed
            out = _do(*args, **kwargs)
            if state["left"] == 0:
                raise Killed
            if state["left"] is not None:
                state["left"] -= 1
            return out

        monkeypatch.setattr(storage, name, step)
    return state


def fake_run(root, batch, text):
    run = publication.new_run(batch)
    (root / run / "data").mkdir(parents=True)
    (root / run / "data" / "part").write_text(text)
    return run


def held(spark, root):
    """What the files of the published runs say."""
    return [(root / r.run / "data" / "part").read_text() for r in publication.records(spark, str(root)) if r.run]


@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize("batch", [None, 1])
def test_death_at_any_step_leaves_the_old_or_the_new_dataset(spark, tmp_path, killer, batch, after):
    first_steps = None
    for kill_at in range(40):
        root = tmp_path / str(kill_at)
        killer["left"] = None
        publication.publish(spark, str(root), fake_run(root, None, "whole"), {"train": 5})
        for k in (0, 1, 2):
            publication.publish(spark, str(root), fake_run(root, k, f"batch {k}"), {"train": 1}, batch=k)
        old = held(spark, root)
        new = ["again"] if batch is None else ["whole", "batch 0", "again", "batch 2"]
        killer.update(left=kill_at, after=after, steps=0)
        try:
            publication.publish(spark, str(root), fake_run(root, batch, "again"), {"train": 2}, batch=batch)
            first_steps = kill_at
        except Killed:
            pass
        killer["left"] = None
        assert held(spark, root) in (old, new)
        # The job is run again; nothing of the broken try is left.
        record = publication.publish(spark, str(root), run := fake_run(root, batch, "again"), {"train": 2}, batch=batch)
        assert held(spark, root) == new and record.totals["train"] == (2 if batch is None else 9)
        assert os.listdir(root / os.path.dirname(run)) == [os.path.basename(run)]
        assert all(n.endswith(".json") for _, _, names in os.walk(root / "published") for n in names if not n.startswith("."))
        if first_steps is not None:
            break
    assert first_steps is not None and first_steps >= 2


def test_a_whole_run_ends_the_batches_before_it(spark, tmp_path):
    for k in range(3):
        publication.publish(spark, str(tmp_path), fake_run(tmp_path, k, str(k)), {"train": 1}, batch=k)
    publication.publish(spark, str(tmp_path), fake_run(tmp_path, None, "w"), {"train": 7, "test": 0})
    assert held(spark, tmp_path) == ["w"] and os.listdir(tmp_path / "runs") == ["whole"]
    record = publication.publish(spark, str(tmp_path), fake_run(tmp_path, 3, "3"), {"test": 2}, batch=3)
    assert held(spark, tmp_path) == ["w", "3"] and record.totals == {"train": 7, "test": 2}


def test_batch_numbers_that_start_anew(spark, tmp_path):
    for k in range(3):
        publication.publish(spark, str(tmp_path), fake_run(tmp_path, k, str(k)), {"train": 1 + k}, batch=k)
    record = publication.publish(spark, str(tmp_path), fake_run(tmp_path, 0, "new"), {"test": 4}, batch=0)
    assert record.totals == {"train": 5, "test": 4} and held(spark, tmp_path) == ["new", "1", "2"]


def test_a_batch_costs_the_same_however_many_came_before(spark, tmp_path, monkeypatch):
    opened = []
    read_text, names = storage.read_text, storage.names
    monkeypatch.setattr(storage, "read_text", lambda s, p: opened.append(p) or read_text(s, p))
    monkeypatch.setattr(storage, "names", lambda s, p: opened.extend(found := names(s, p)) or found)
    costs = []
    for k in range(200):
        opened.clear()
        rows = {"train": 2} if k % 10 else {}
        record = publication.publish(spark, str(tmp_path), None, rows, batch=k)
        costs.append(len(opened))
    assert record.totals == {"train": 360} and max(costs[2:]) == min(costs[2:]) <= 6
    again = publication.publish(spark, str(tmp_path), None, {"train": 2}, batch=199)
    assert again.totals == record.totals


# ---- adaptation ---------------------------------------------------------------------------------

CLIPS = {f"a{i}": make_wav(np.linspace(-0.5, 0.5, 40 + i)) for i in range(6)}


@pytest.fixture
def export(spark, make_export):
    lines = [manifest_line(name, split=("train", "test")[i % 2]) for i, name in enumerate(CLIPS)]
    return open_export(spark, make_export(lines, CLIPS))


def ids(rows):
    return sorted(r.annotation_id for r in rows.collect())


def test_written_audio_is_not_moved(spark, export, tmp_path, monkeypatch):
    moved = []
    rename = storage.rename
    monkeypatch.setattr(storage, "rename", lambda s, a, b: moved.append((a, b)) or rename(s, a, b))
    adapt_binary_endpoint(spark, export, str(tmp_path / "out"), "en")
    assert len(moved) == 1 and all("/published/whole/" in p for p in moved[0])


def test_a_run_that_is_not_published_is_not_read(spark, export, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    adapt_binary_endpoint(spark, export, out, "en")
    with open(export.manifest_path, "a", encoding="utf-8") as f:
        f.write(manifest_line("a0", split="validation") + "\n")

    def die(*args, **kwargs):
        raise Killed

    with monkeypatch.context() as patch:
        patch.setattr(publication, "publish", die)
        with pytest.raises(Killed):
            adapt_binary_endpoint(spark, export, out, "en")
    assert len(os.listdir(f"{out}/runs/whole")) == 2
    assert dataset_splits(spark, out) == ["train", "test"] and ids(read_dataset(spark, out)) == sorted(CLIPS)
    adapt_binary_endpoint(spark, export, out, "en")
    assert dataset_splits(spark, out) == ["train", "validation", "test"] and len(os.listdir(f"{out}/runs/whole")) == 1
    with pytest.raises(FileNotFoundError):
        read_dataset(spark, out, "other")


@pytest.mark.parametrize("how", ["by_path", "scan"])
def test_quarantine_converts_good_clips_once(spark, export, tmp_path, monkeypatch, how):
    for name in ("a1", "a4"):
        with open(f"{export.clips_dir}/{name}.wav", "wb") as f:
            f.write(b"noise")
    with open(export.manifest_path, "a", encoding="utf-8") as f:
        f.write(manifest_line("b1", clipPath="clips/a1.wav") + "\n")
    asked = []
    convert = adapt_plan.canonical_clips

    def counted(session, manifest, *rest):
        asked.append(ids(manifest))
        return convert(session, manifest, *rest)

    monkeypatch.setattr(adapt_plan, "canonical_clips", counted)
    out = str(tmp_path / "out")
    result = adapt_binary_endpoint(spark, export, out, "en", how=how, on_error="quarantine")
    assert asked == [["a0", "a1", "a2", "a3", "a4", "a5", "b1"], ["a1", "a4", "b1"]]
    assert result.split_counts == {"train": 2, "test": 2} and ids(read_dataset(spark, out)) == ["a0", "a2", "a3", "a5"]
    aside = read_quarantine(spark, out)
    assert ids(aside) == ["a1", "a4", "b1"] and "bytes" not in aside.columns
    assert all("WAV" in r.error for r in aside.collect())


def test_a_clip_that_can_be_read_at_the_second_try_joins_the_run(spark, export, tmp_path, monkeypatch):
    convert, calls = adapt_plan.canonical_clips, []

    def failing_first(session, manifest, *rest):
        rows = convert(session, manifest, *rest)
        calls.append(1)
        bad = F.col("annotation_id").isin("a2", "a3") & F.lit(len(calls) == 1) | (F.col("annotation_id") == "a3")
        return rows.withColumns({"error": F.when(bad, F.lit("not now")), "bytes": F.when(~bad, F.col("bytes"))})

    monkeypatch.setattr(adapt_plan, "canonical_clips", failing_first)
    out = str(tmp_path / "out")
    result = adapt_binary_endpoint(spark, export, out, "en", on_error="quarantine")
    assert result.split_counts == {"train": 3, "test": 2} and ids(read_dataset(spark, out)) == ["a0", "a1", "a2", "a4", "a5"]
    assert ids(read_quarantine(spark, out)) == ["a3"]


def test_all_clips_broken(spark, make_export, tmp_path):
    export = open_export(spark, make_export([manifest_line("x")], {"x": b""}))
    out = str(tmp_path / "out")
    assert adapt_binary_endpoint(spark, export, out, "en", on_error="quarantine").split_counts == {}
    assert dataset_splits(spark, out) == [] and ids(read_quarantine(spark, out)) == ["x"]


def test_a_repeated_batch_counts_once(spark, export, tmp_path):
    out, manifest = str(tmp_path / "out"), export.manifest()
    to_dataset = lambda rows: binary_endpoint(rows, "en")
    for batch in (0, 1, 1):
        part = manifest.where(F.col("split") == ("train", "test")[batch])
        record = publish_rows(spark, part, validate_manifest(part), export.clips_dir, out, to_dataset, batch=batch)
    assert record.totals == {"train": 3, "test": 3} and ids(read_dataset(spark, out)) == sorted(CLIPS)


def test_a_stream_opens_no_file_of_an_earlier_batch(spark, export, tmp_path):
    incoming, out = tmp_path / "incoming", tmp_path / "out"
    incoming.mkdir()
    for k, name in enumerate(CLIPS):
        (incoming / f"{k}.jsonl").write_text("\n" if k == 4 else manifest_line(name) + "\n")
        run = adapt_stream(spark, str(incoming), export.clips_dir, str(out), str(tmp_path / "checkpoint"), "en")
        run.awaitTermination()
        for part in out.glob("runs/batch=*/*/data/*/*.parquet"):
            part.write_bytes(b"no Parquet file")
    meta = json.loads((out / "export_meta.json").read_text())
    assert meta["split_counts"] == {"train": 5} and dataset_splits(spark, str(out)) == ["train"]
    assert "runs/batch=*/*/data/split=train/*.parquet" in (out / "README.md").read_text()


# ---- line numbers -------------------------------------------------------------------------------


@pytest.fixture
def small_blocks(spark):
    with storage.setting(spark, "spark.sql.files.maxPartitionBytes", "700b"), storage.setting(spark, "spark.sql.files.openCostInBytes", "0b"):
        yield


def test_bad_lines_are_numbered_across_blocks_and_files(spark, tmp_path, small_blocks):
    rng, want = random.Random(5), []
    for name in ("a.jsonl", "b.jsonl"):
        lines = [rng.choice([manifest_line(f"x{i}"), manifest_line(f"x{i}", fill="é" * rng.randrange(400)), "", " "]) for i in range(60)]
        for i in rng.sample(range(60), 5) + [59]:
            lines[i] = f"{{broken {i}"
        want += [(name, i + 1, line) for i, line in enumerate(lines) if line.startswith("{broken")]
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if name == "a.jsonl" else ""), encoding="utf-8")
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    got = [(os.path.basename(r.file), r.number, r.line) for r in bad_lines(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    plan = bad_lines(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and plan.count("Join") == 1


def test_a_job_names_the_line(spark, make_export, tmp_path, small_blocks):
    lines = [manifest_line(f"a{i}") for i in range(20)] + ["", manifest_line("b", labelValue="7"), manifest_line("c"), "[]"]
    export = open_export(spark, make_export(lines, {}))
    with pytest.raises(ManifestError, match=r"manifest\.jsonl:22: invalid manifest line, field labelValue .*1 more bad line"):
        adapt_binary_endpoint(spark, export, str(tmp_path / "out"), "en")
    assert not os.path.exists(tmp_path / "out")


def test_a_stream_names_the_line(spark, make_export, tmp_path):
    root = make_export([], CLIPS)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "fine.jsonl").write_text(manifest_line("a0") + "\n")
    (tmp_path / "in" / "worse.jsonl").write_text("\n" + manifest_line("a1") + "\nbroken\n")
    with pytest.raises(Exception, match=r"worse\.jsonl:3: invalid manifest line, not valid JSON"):
        adapt_stream(spark, str(tmp_path / "in"), f"{root}/clips", str(tmp_path / "out"), str(tmp_path / "cp"), "en").awaitTermination()


def test_other_failures_stay_what_they_are(spark):
    broken = spark.range(1).select(F.raise_error(F.lit("some other fault")).alias("x"))
    with pytest.raises(Exception, match="some other fault"), staged_manifest(spark, broken):
        pass
