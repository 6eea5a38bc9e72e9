"""Reading written datasets back, through the records that name their runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmill import publication, storage
from clipmill.schemas import DATASET, SPLITS
from clipmill.sinks.dataset import DATA, QUARANTINE


def dataset_splits(spark: SparkSession, out_dir: str) -> list[str]:
    """The splits with rows; an empty split is not written, so not offered."""
    held = {s for record in publication.records(spark, out_dir) for s in record.splits}
    return [s for s in SPLITS if s in held]


def read_dataset(spark: SparkSession, out_dir: str, split: str | None = None) -> DataFrame:
    """One split, or all splits with a ``split`` column, of the runs published at this moment."""
    found = publication.records(spark, out_dir)
    parts = []
    for name in SPLITS if split is None else [split]:
        paths = [storage.join(out_dir, r.run, DATA, f"split={name}") for r in found if r.splits.get(name)]
        if paths:
            parts.append(spark.read.schema(DATASET).parquet(*paths).withColumn("split", F.lit(name)))
    if not parts:
        raise FileNotFoundError(f"{out_dir}: no split {split or ''} published")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows if split is None else rows.drop("split")


def read_quarantine(spark: SparkSession, out_dir: str) -> DataFrame | None:
    """Manifest rows set aside for their clips, with ``error``; none if no published run has any."""
    found = [r.run for r in publication.records(spark, out_dir) if r.quarantined]
    return spark.read.parquet(*[storage.join(out_dir, run, QUARANTINE) for run in found]) if found else None
