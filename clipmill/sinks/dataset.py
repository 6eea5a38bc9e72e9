"""Writing split datasets and their card."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from clipmill import storage
from clipmill.schemas import DATASET, DATASET_FIELDS, SPLITS, TARGET_RATE

TOOL = "clipmill adapt binary-endpoint"
META_FILE = "export_meta.json"
#: What a run's directory holds.
DATA, QUARANTINE = "data", "quarantine"
RECORDS_PER_FILE = 20_000


def split_counts_of(spark: SparkSession, run_dir: str) -> dict[str, int]:
    """Rows of each split that a run has written, as its files' footers tell."""
    schema = T.StructType([*DATASET.fields, T.StructField("split", T.StringType())])
    rows = spark.read.schema(schema).parquet(storage.join(run_dir, DATA))
    return {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}  # three rows at most


def write_splits(df: DataFrame, run_dir: str, records_per_file: int = RECORDS_PER_FILE, more: bool = False) -> None:
    """Write Snappy part files to ``data/split={split}`` below a run's directory, for splits that have rows.

    All splits are written in one pass, so each clip is decoded once, and files stay where their tasks
    commit them; the run counts from its publication on. Each task keeps one file per split open
    instead of sorting its rows, audio included, by split. ``more`` adds rows to a run.
    """
    with storage.setting(df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", str(len(SPLITS) + 1)):
        (
            df.write.partitionBy("split")
            .mode("append" if more else "error")
            .option("compression", "snappy")
            .option("maxRecordsPerFile", records_per_file)
            .parquet(storage.join(run_dir, DATA))
        )


_LOADING = """
Records in `published` name the finished runs; files of other runs are not part of the dataset.
Hugging Face `datasets` reads the files as they are:

```python
import datasets

clips = datasets.load_dataset("parquet", data_files={files})
clips = clips.cast_column("audio", datasets.Audio(sampling_rate={rate}))
```
"""


def _card(counts: dict[str, int], language: str, runs: list[str]) -> str:
    """What the directory holds: clips per split, how to load them, the fields of a row.

    ``runs`` are patterns of the directories of published runs.
    """
    present = [s for s in SPLITS if counts.get(s)]
    lines = ["# Speech clips labelled for end of turn", ""]
    lines += [f"{sum(counts.values())} clips, language `{language}`, made by `{TOOL}`.", ""]
    lines += [f"- {s}: {counts[s]} clips" for s in present]
    files = {s: [f"{run}/{DATA}/split={s}/*.parquet" for run in runs] for s in present}
    lines.append(_LOADING.format(files=files, rate=TARGET_RATE))
    lines += ["Each row has these fields:", ""]
    lines += [f"- `{f.name}` ({f.dataType.simpleString()}): {DATASET_FIELDS[f.name]}" for f in DATASET.fields]
    return "\n".join(lines) + "\n"


def write_dataset_card(
    spark: SparkSession, out_dir: str, counts: dict[str, int], params: dict, runs: list[str]
) -> None:
    """README and provenance JSON next to the runs."""
    storage.write_text(spark, storage.join(out_dir, "README.md"), _card(counts, params["language"], runs))
    meta = {
        "tool": TOOL,
        "manifest": params["manifest"],
        "clips_dir": params["clips_dir"],
        "language": params["language"],
        "split_counts": dict(sorted(counts.items())),
    }
    storage.write_text(spark, storage.join(out_dir, META_FILE), json.dumps(meta, indent=2, ensure_ascii=False))
