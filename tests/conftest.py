import json
import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .appName("clipmill-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def conf(spark):
    """Set session options for one test."""
    before = {}

    def put(key, value):
        before.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)

    yield put
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def make_wav(samples, rate=16_000, channels=1):
    """A 16-bit WAV file from float samples in [-1, 1]."""
    from clipmill.functions import wav

    stored = (np.asarray(samples, dtype=np.float64) * 32767).astype("<i2")
    return wav.encode(stored.tobytes(), channels, rate, 16)


def manifest_line(clip_id, label="end_of_turn", split="train", **changes):
    record = {
        "annotationId": clip_id,
        "clipPath": f"clips/{clip_id}.wav",
        "clipSha256": f"digest of {clip_id}",
        "clipDurationSec": 0.25 + len(clip_id),
        "clipSampleRate": 16000,
        "labelKey": label,
        "labelValue": int(label == "end_of_turn"),
        "startSec": 0.0,
        "endSec": 2.25,
        "padSec": 0.0,
        "sourceFileId": f"recording {clip_id[-1:]}",
        "sourceFileSha256": f"digest of recording {clip_id[-1:]}",
        "labellerId": 40 + len(clip_id),
        "reviewStatus": "approved",
        "split": split,
    }
    record.update(changes)
    return json.dumps({k: v for k, v in record.items() if v is not ...})


@pytest.fixture
def make_export(tmp_path):
    """Write an export directory: manifest lines plus clips by id."""

    def write(lines, clips):
        root = tmp_path / "export"
        (root / "clips").mkdir(parents=True)
        (root / "manifest.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
        for name, data in clips.items():
            (root / "clips" / f"{name}.wav").write_bytes(data)
        return str(root)

    return write
