"""Writing manifests as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmill import storage
from clipmill.schemas import MANIFEST, MANIFEST_EXTRAS, wire_name


def manifest_line(df: DataFrame) -> Column:
    """One camelCase JSON object per row; optional fields that are unset stay as null."""
    names = [*MANIFEST.fieldNames(), *[c for c in MANIFEST_EXTRAS if c in df.columns]]
    record = F.struct(*[F.col(c).alias(wire_name(c)) for c in names])
    return F.to_json(record, {"ignoreNullFields": "false"})


def write_manifest(df: DataFrame, out_dir: str, name: str = "manifest.jsonl") -> str:
    """Write ``<out_dir>/manifest.jsonl``, a directory of line files, and return its path."""
    path = storage.join(out_dir, name)
    df.select(manifest_line(df).alias("value")).write.mode("overwrite").text(path)
    return path
