"""Manifest checks, all of them in one aggregate before any audio is touched."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmill.schemas import BINARY_LABELS, MANIFEST, SPLITS, required_fields


class ManifestError(ValueError):
    """The manifest breaks a rule; the message names the value."""


@dataclass(frozen=True)
class ManifestProfile:
    """What the checking pass learned: row counts and the size of the text columns."""

    total: int
    split_counts: dict[str, int]
    text_bytes: int


def _rules() -> dict[str, tuple[Column, Column]]:
    """Rule name -> (violated, value to show)."""
    rules = {}
    for name in required_fields(MANIFEST):
        rules[f"{name} is missing"] = (F.col(name).isNull(), F.lit(name))
    rules["unknown split"] = (~F.col("split").isin(list(SPLITS)), F.col("split"))
    rules["unknown label"] = (~F.col("label_key").isin(list(BINARY_LABELS)), F.col("label_key"))
    return rules


def _rule_measures() -> list[Column]:
    """Count ``n<i>`` and smallest offending value ``s<i>`` of rule ``i``."""
    measures = []
    for i, (broken, shown) in enumerate(_rules().values()):
        measures += [F.count_if(broken).alias(f"n{i}"), F.min(F.when(broken, shown)).alias(f"s{i}")]
    return measures


def manifest_violations(manifest: DataFrame) -> DataFrame:
    """One row per rule: how many rows break it and the smallest offending value."""
    one_row = manifest.agg(*_rule_measures())
    entries = F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule"),
                F.col(f"n{i}").alias("violations"),
                F.col(f"s{i}").alias("sample"),
            )
            for i, rule in enumerate(_rules())
        ]
    )
    return one_row.select(F.inline(entries))


def validate_manifest(manifest: DataFrame, allow_empty: bool = False) -> ManifestProfile:
    """Raise on the first broken rule, else report counts. One pass over the manifest."""
    text_columns = [f.name for f in MANIFEST.fields if f.dataType.typeName() == "string"]
    row_bytes = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint") for c in text_columns), F.lit(0))
    row = manifest.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum(row_bytes), F.lit(0)).alias("text_bytes"),
        *[F.count_if(F.col("split") == s).alias(f"rows_{s}") for s in SPLITS],
        *_rule_measures(),
    ).head()
    if row.total == 0 and not allow_empty:
        raise ManifestError("manifest is empty")
    for i, rule in enumerate(_rules()):
        if row[f"n{i}"]:
            raise ManifestError(f"{rule}: {row[f's{i}']!r} ({row[f'n{i}']} of {row.total} rows)")
    counts = {s: row[f"rows_{s}"] for s in SPLITS if row[f"rows_{s}"]}
    return ManifestProfile(row.total, counts, row.text_bytes)
