"""Clip throughput by core count: ``python bench_clips.py [sf_dir]``.

Every waveform of the embeddings table is repeated into three seconds of 48 kHz stereo, stored as
16-bit WAV files, then scanned and canonicalised with 1, 2, 4 and 8 cores. Prints one JSON line.
"""

from __future__ import annotations

import json
import subprocess
import sys
import time

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipmill import storage
from clipmill.functions import wav
from clipmill.operators.audio import canonicalize_clips, map_rows, settle_errors, try_canonicalize_files
from clipmill.sources.clips import read_clips
from compare import local_session
from workload import Tables
from workload.jobs import store_clips

SECONDS, RATE, CHANNELS = 3, 48_000, 2
#: Rows that name each clip, so that starting the job is a small part of the time by path.
TIMES = 8


def write_long_clips(t: Tables, folder: str) -> int:
    made = T.StructType([T.StructField("content", T.BinaryType())])

    def convert(row):
        samples = np.asarray(row["samples"].values, dtype=np.float32)
        stored = np.resize((samples * 32767).astype("<i2"), SECONDS * RATE * CHANNELS)
        data = wav.encode(stored.tobytes(), CHANNELS, RATE, 16)
        return {"content": data}, len(data)

    path = F.concat(F.lit("clips/"), F.col("clip_id").cast("string"), F.lit(".wav"))
    rows = t.waveforms.repartition(t.spark.sparkContext.defaultParallelism).withColumn("clip_path", path)
    return store_clips(map_rows(rows, convert, ("samples",), made), folder)


def measure(folder: str, cores: int) -> dict[str, float]:
    """Clips per second of a full pass by each way, after a first pass that starts the workers."""
    spark = local_session(cores)
    clips = read_clips(spark, folder)
    count = clips.count()
    # The names as a table, as a staged manifest has them.
    names = storage.join(storage.scratch_dir(spark, "names"), "names")
    clips.select("rel", F.col("rel").alias("clip_path")).write.parquet(names)
    again = F.explode(F.sequence(F.lit(1), F.lit(TIMES))).alias("time")
    rows = spark.read.parquet(names).select("*", again).repartition(4 * cores)
    ways = {
        "by_path": (TIMES * count, settle_errors(try_canonicalize_files(rows, folder))),
        "scan": (count, canonicalize_clips(clips.withColumnRenamed("rel", "clip_path"))),
    }
    rates = {}
    for way, (n, df) in ways.items():
        for _ in range(2):
            start = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
        rates[way] = round(n / took, 1)
    return rates


def main() -> None:
    if sys.argv[1:2] == ["--measure"]:
        print(json.dumps(measure(sys.argv[2], int(sys.argv[3]))))
        return
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session()
    folder = storage.join(storage.scratch_dir(spark, "long-clips"), "clips")
    count = write_long_clips(Tables(spark, sf_dir), folder)
    spark.stop()
    rates = {}
    for cores in (1, 2, 4, 8):
        # A session of its own for each core count.
        run = [sys.executable, __file__, "--measure", folder, str(cores)]
        output = subprocess.run(run, capture_output=True, check=True, text=True).stdout
        rates[cores] = json.loads(output.strip().splitlines()[-1])
    print(json.dumps({"clips": count, "seconds_each": SECONDS, "clips_per_second": rates}))


if __name__ == "__main__":
    main()
