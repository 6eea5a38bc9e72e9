"""Export to training set: validate, attach clips, canonicalise, write one dataset per split."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipmill import publication, storage
from clipmill.functions.fields import label_to_endpoint
from clipmill.operators.audio import settle_errors
from clipmill.operators.joins import spread_lookup
from clipmill.operators.validate import ManifestProfile, validate_manifest
from clipmill.publication import Record
from clipmill.schemas import DATASET
from clipmill.sinks.dataset import DATA, QUARANTINE, split_counts_of, write_dataset_card, write_splits
from clipmill.sources.clips import canonical_clips
from clipmill.sources.export_dir import Export
from clipmill.sources.manifest import staged_manifest


# Spark reads Parquet in batches of 4,096 rows, which is too much memory for rows with audio.
AUDIO_ROWS_PER_BATCH = "128"


@dataclass(frozen=True)
class AdaptResult:
    total: int
    split_counts: dict[str, int]


def _required(field: T.StructField, value: Column) -> Column:
    """A null fails the job. The closing constant is never reached; for the optimizer it makes the
    column non-null, and so in the written files."""
    refusal = F.raise_error(F.lit(f"{field.name} is null")).cast(field.dataType)
    return F.coalesce(value, refusal, F.lit("0").cast(field.dataType)).alias(field.name)


def binary_endpoint(rows: DataFrame, language: str) -> DataFrame:
    """Manifest rows with canonical ``bytes`` to the nine dataset columns, plus ``split``."""
    made = {
        "audio": F.struct(F.col("bytes"), F.col("clip_path").alias("path")),
        "endpoint_bool": label_to_endpoint(F.col("label_key")),
        "language": F.lit(language),
    }
    columns = []
    for field in DATASET.fields:
        value = made.get(field.name, F.col(field.name))
        nested = isinstance(field.dataType, T.StructType)
        columns.append(value.alias(field.name) if nested else _required(field, value))
    return rows.select(*columns, "split")


# name -> function(rows with canonical bytes, **options) -> dataset rows plus split
ADAPTERS: dict[str, Callable[..., DataFrame]] = {"binary_endpoint": binary_endpoint}


def adapt(
    spark: SparkSession,
    export: Export,
    out_dir: str,
    language: str,
    adapter: str = "binary_endpoint",
    how: str = "auto",
    on_error: str = "fail",
) -> AdaptResult:
    """Run an adapter over an export and publish the dataset with its card.

    All manifest rules are checked in one pass before any clip is read. With
    ``on_error='quarantine'`` rows whose clip is broken go to the run's ``quarantine`` directory.
    """
    to_dataset = partial(ADAPTERS[adapter], language=language)
    with staged_manifest(spark, export.manifest(), export.manifest_path) as manifest:
        profile = validate_manifest(manifest)
        record = publish_rows(spark, manifest, profile, export.clips_dir, out_dir, to_dataset, how, on_error)
    params = {"manifest": export.manifest_path, "clips_dir": export.clips_dir, "language": language}
    write_dataset_card(spark, out_dir, record.totals, params, [record.run])
    return AdaptResult(sum(record.splits.values()), record.splits)


def publish_rows(
    spark: SparkSession,
    manifest: DataFrame,
    profile: ManifestProfile,
    clips_dir: str,
    out_dir: str,
    to_dataset: Callable[[DataFrame], DataFrame],
    how: str = "auto",
    on_error: str = "fail",
    batch: int | None = None,
) -> Record:
    """Convert all clips of a manifest into a run, then publish it (as a batch of a stream, if given)."""
    run = publication.new_run(batch)
    run_dir = storage.join(out_dir, run)
    try:
        counts, quarantined = _write_run(spark, manifest, profile, clips_dir, run_dir, to_dataset, how, on_error)
    except Exception:
        publication.discard(spark, out_dir, run)
        raise
    return publication.publish(spark, out_dir, run, counts, quarantined, batch)


def _write_run(
    spark: SparkSession, manifest: DataFrame, profile: ManifestProfile, clips_dir: str, run_dir: str, to_dataset, how: str, on_error: str
) -> tuple[dict[str, int], int]:
    """Write a run's splits, and its quarantine if it has one; returns rows by split, and rows set aside."""
    rows = canonical_clips(spark, manifest, clips_dir, profile, how)
    if on_error != "quarantine":
        write_splits(to_dataset(settle_errors(rows, on_error)), run_dir)
        return profile.split_counts, 0
    write_splits(to_dataset(rows.where("error is null").drop("error")), run_dir)
    counts, quarantined = split_counts_of(spark, run_dir), 0
    if sum(counts.values()) < profile.total:
        quarantined = _set_aside(spark, manifest, profile, clips_dir, run_dir, to_dataset, how)
        counts = split_counts_of(spark, run_dir)
    return counts, quarantined


def _set_aside(
    spark: SparkSession, manifest: DataFrame, profile: ManifestProfile, clips_dir: str, run_dir: str, to_dataset, how: str
) -> int:
    """Write the rows that the run lacks to its quarantine, with the error; returns how many.

    Good clips are neither decoded nor written again: the run's clip paths, which are read without the
    audio, tell which clips are missing, and only those are tried once more for their error. One that
    can be read now joins the run.
    """
    written = spark.read.schema(DATASET).parquet(storage.join(run_dir, DATA)).select(F.col("audio.path").alias("clip_path"))
    lost = manifest.select("clip_path").distinct().join(written.distinct(), "clip_path", "left_anti")
    rest = spread_lookup(manifest, lost, "clip_path", "annotation_id", "left_semi").select(*manifest.columns)
    with storage.staged(rest, "second-try") as rest:
        again = canonical_clips(spark, rest, clips_dir, replace(profile, total=rest.count()), how)
        small = storage.setting(spark, "spark.sql.parquet.columnarReaderBatchSize", AUDIO_ROWS_PER_BATCH)
        with storage.staged(again, "tried") as tried, small:
            bad = tried.where("error is not null").drop("bytes")
            bad.write.parquet(storage.join(run_dir, QUARANTINE))
            n_bad = bad.count()
            if n_bad < tried.count():
                write_splits(to_dataset(tried.where("error is null").drop("error")), run_dir, more=True)
            return n_bad


def adapt_binary_endpoint(
    spark: SparkSession, export: Export, out_dir: str, language: str, **options
) -> AdaptResult:
    return adapt(spark, export, out_dir, language, "binary_endpoint", **options)
