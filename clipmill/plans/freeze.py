"""Freezing an export: filtered annotations with a seeded split, as a manifest."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from clipmill import storage
from clipmill.operators.aggregates import manifest_fingerprint
from clipmill.operators.filters import filter_export
from clipmill.operators.joins import reserved_file_ids, resolve_label_set, spread_lookup
from clipmill.operators.splits import assign_split
from clipmill.schemas import MANIFEST, MANIFEST_EXTRAS, wire_name
from clipmill.sinks.manifest import write_manifest
from clipmill.spec import ExportSpec


@dataclass(frozen=True)
class FrozenExport:
    """Manifest rows, the one-row export record, and the reserved files it was frozen with.

    The reserved ids are a table of their own: their number is not bounded, so they do not go
    into one JSON field.
    """

    manifest: DataFrame
    export: DataFrame
    reserved_files: DataFrame


def manifest_rows(annotations: DataFrame) -> DataFrame:
    """Split annotations in the shape of manifest records.

    Annotations carry ``clip_sha256``, ``clip_sample_rate`` and ``source_file_sha256`` of the clip
    cut for them.
    """
    named = {
        "annotation_id": F.col("id"),
        "clip_path": F.concat(F.lit("clips/"), F.col("id"), F.lit(".wav")),
        "clip_duration_sec": F.col("end_sec") - F.col("start_sec"),
        "source_file_id": F.col("file_id"),
        "labeller_id": F.col("created_by"),
    }
    columns = [named.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in MANIFEST.fields]
    extras = [F.col(c) for c in MANIFEST_EXTRAS if c in annotations.columns]
    return annotations.select(*columns, *extras)


def freeze_manifest(
    annotations: DataFrame, files: DataFrame, spec: ExportSpec, label_set_id: str, exact: bool = False
) -> DataFrame:
    """Filter, mark reserved files, assign splits: all lazy, no shuffle beyond the file lookup."""
    project_files = files.where(F.col("project_id") == spec.project_id).select(
        F.col("id").alias("file_id"), F.col("test_reserved_at").isNotNull().alias("reserved")
    )
    # One lookup settles both the project and the reservation.
    chosen = spread_lookup(
        filter_export(annotations, spec, label_set_id), project_files, "file_id", "id", how="inner"
    )
    return manifest_rows(assign_split(chosen, spec.split, spec.use_reserved_test_files, exact))


def export_record(
    manifest: DataFrame,
    spec: ExportSpec,
    label_set_id: str,
    export_id: str,
    created_by: int,
    created_at: str,
    clips: DataFrame | None = None,
) -> DataFrame:
    """The one-row export record of a manifest.

    It has every field of `EXPORTS`, so a page of records reads back. ``clips`` (``annotation_id,
    length``) gives the total bytes, which are null without it. The export is ready as soon as it is
    frozen, and its files belong under ``exports/<id>``.
    """
    total_bytes = F.lit(None).cast("bigint")
    if clips is not None:
        ids = manifest.select("annotation_id")
        total_bytes = clips.join(ids, "annotation_id", "left_semi").agg(F.sum("length")).scalar()
    body = F.lit(spec.to_json(label_set_id))
    return manifest_fingerprint(manifest).select(
        F.lit(export_id).alias("id"),
        F.lit(spec.project_id).alias("project_id"),
        F.lit(spec.name).alias("name"),
        F.lit(spec.description).cast("string").alias("description"),
        F.lit("ready").alias("status"),
        F.get_json_object(body, "$.filter").alias("filter"),
        F.get_json_object(body, "$.splitPolicy").alias("split_policy"),
        F.to_json(F.struct(F.lit(label_set_id).alias("id"))).alias("label_set_snapshot"),
        F.lit(f"exports/{export_id}").alias("r2_prefix"),
        "manifest_sha256",
        "clip_count",
        total_bytes.alias("total_bytes"),
        F.lit(created_by).cast("bigint").alias("created_by"),
        F.lit(None).cast("string").alias("created_by_login"),
        F.lit(created_at).alias("created_at"),
        F.lit(created_at).alias("ready_at"),
        F.lit(None).cast("string").alias("error_message"),
        F.lit(True).alias("can_download"),
        F.lit(True).alias("can_delete"),
    )


def _held_out(files: DataFrame, spec: ExportSpec, export_id: str) -> DataFrame:
    """The reserved files an export used: none unless it asked for them."""
    used = F.col("project_id") == spec.project_id
    if spec.use_reserved_test_files is not True:
        used = F.lit(False)
    return reserved_file_ids(files.where(used)).withColumn("export_id", F.lit(export_id))


def freeze_export(
    annotations: DataFrame,
    files: DataFrame,
    projects: DataFrame,
    spec: ExportSpec,
    export_id: str,
    created_by: int,
    created_at: str,
    clips: DataFrame | None = None,
    exact: bool = False,
) -> FrozenExport:
    """The export as lazy tables; :func:`save_export` writes it."""
    label_set = resolve_label_set(projects, spec.project_id, spec.label_set_id)
    manifest = freeze_manifest(annotations, files, spec, label_set, exact)
    record = export_record(manifest, spec, label_set, export_id, created_by, created_at, clips)
    return FrozenExport(manifest, record, _held_out(files, spec, export_id))


def save_export(
    annotations: DataFrame,
    files: DataFrame,
    projects: DataFrame,
    spec: ExportSpec,
    export_id: str,
    out_dir: str,
    created_by: int,
    created_at: str,
    clips: DataFrame | None = None,
    exact: bool = False,
) -> Row:
    """Write ``manifest.jsonl``, ``export.json`` and ``reserved_files.parquet``; returns the record.

    The manifest is computed once, so that count and fingerprint are those of the rows written.
    """
    spark = annotations.sparkSession
    label_set = resolve_label_set(projects, spec.project_id, spec.label_set_id)
    with storage.staged(freeze_manifest(annotations, files, spec, label_set, exact), "manifest") as manifest:
        write_manifest(manifest, out_dir)
        record = export_record(manifest, spec, label_set, export_id, created_by, created_at, clips).head()
    _held_out(files, spec, export_id).write.mode("overwrite").parquet(storage.join(out_dir, "reserved_files.parquet"))
    body = {wire_name(name): value for name, value in record.asDict().items()}
    body |= {name: json.loads(body[name]) for name in ("filter", "splitPolicy", "labelSetSnapshot")}
    storage.write_text(spark, storage.join(out_dir, "export.json"), json.dumps(body, ensure_ascii=False, indent=2))
    return record
