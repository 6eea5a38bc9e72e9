"""Locating the two inputs of an adaptation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from clipmill import storage
from clipmill.sources.clips import read_clips
from clipmill.sources.manifest import read_manifest


@dataclass(frozen=True)
class Export:
    """Where an export's manifest and clips lie."""

    spark: SparkSession
    manifest_path: str
    clips_dir: str

    def manifest(self) -> DataFrame:
        return read_manifest(self.spark, self.manifest_path)

    def clips(self) -> DataFrame:
        return read_clips(self.spark, self.clips_dir)


def open_export(
    spark: SparkSession,
    export_dir: str | None = None,
    manifest: str | None = None,
    clips_dir: str | None = None,
) -> Export:
    """An export directory holding ``manifest.jsonl`` and ``clips/``, or both paths on their own.

    The directory wins when both are given. A missing input is an error naming it.
    """
    if export_dir is not None:
        manifest, clips_dir = storage.join(export_dir, "manifest.jsonl"), storage.join(export_dir, "clips")
    for name, path in (("manifest", manifest), ("clips_dir", clips_dir)):
        if path is None:
            raise ValueError(f"{name} is needed when export_dir is not given")
        if not storage.exists(spark, path):
            raise FileNotFoundError(f"{path}: {name.removesuffix('_dir')} not found")
    return Export(spark, manifest, clips_dir)
