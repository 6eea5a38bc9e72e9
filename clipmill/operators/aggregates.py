"""Counts and measures. All of them combine on the map side before they shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipmill.operators.joins import reserved_file_ids
from clipmill.schemas import DEFAULT_PAGE_SIZE, MANIFEST

# Seconds are summed as whole microseconds, so the result does not depend on the order in which
# tasks finish.
_MICROS = 1_000_000

_DIGEST_WORD = 6


def split_counts(manifest: DataFrame) -> DataFrame:
    """Rows per split, with the total over the (at most three) splits alongside."""
    counts = manifest.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy()))


def export_stats(clips: DataFrame) -> DataFrame:
    """Clip count and bytes per export, from rows of ``export_id, length``."""
    return clips.groupBy("export_id").agg(
        F.count(F.lit(1)).alias("clip_count"), F.sum("length").alias("total_bytes")
    )


def with_export_stats(exports: DataFrame, clips: DataFrame) -> DataFrame:
    """Exports with their clip count and bytes; null until clips exist."""
    stats = export_stats(clips).withColumnRenamed("export_id", "id")
    return exports.join(stats, "id", "left")


def _labelled_by_file(annotations: DataFrame) -> DataFrame:
    # One row per file before any join: a file holding most annotations costs nothing extra.
    micros = F.round((F.col("end_sec") - F.col("start_sec")) * _MICROS).cast("bigint")
    return annotations.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.sum(micros).alias("micros"))


def _summary() -> list[Column]:
    return [
        F.count("file_id").alias("file_count"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("annotation_count"),
        (F.coalesce(F.sum("micros"), F.lit(0)) / _MICROS).alias("labelled_seconds"),
    ]


def reservation_summaries(files: DataFrame, annotations: DataFrame) -> DataFrame:
    """Reserved files, their annotations and labelled seconds, per project."""
    reserved = files.where(F.col("test_reserved_at").isNotNull()).select(
        "project_id", F.col("id").alias("file_id")
    )
    # Both sides hold one row per file, so the join cannot inflate the file count.
    return (
        reserved.join(_labelled_by_file(annotations), "file_id", "left")
        .groupBy("project_id")
        .agg(*_summary())
    )


def reservation_summary(files: DataFrame, annotations: DataFrame, project_id: str) -> DataFrame:
    """One row for one project, zeros when nothing is reserved."""
    reserved = reserved_file_ids(files.where(F.col("project_id") == project_id))
    return reserved.join(_labelled_by_file(annotations), "file_id", "left").agg(*_summary())


def annotation_counts(files: DataFrame, annotations: DataFrame) -> DataFrame:
    """Files with the number of their annotations, 0 when there are none."""
    counts = annotations.groupBy(F.col("file_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    return (
        files.join(counts, "id", "left")
        .withColumn("annotation_count", F.coalesce("_n", F.lit(0)).cast("bigint"))
        .drop("_n")
    )


def page_info(df: DataFrame, page: int = 1, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """One row: page, page size, total rows, total pages and the next page or null."""
    pages = F.ceil(F.col("total") / F.lit(page_size)).cast("bigint")
    return (
        df.agg(F.count(F.lit(1)).alias("total"))
        .select(
            F.lit(page).alias("page"),
            F.lit(page_size).alias("page_size"),
            "total",
            pages.alias("total_pages"),
        )
        .withColumn("next_page", F.when(F.col("page") < F.col("total_pages"), F.col("page") + 1))
    )


def manifest_fingerprint(manifest: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row ``clip_count, manifest_sha256``: a digest of the records, whatever their order.

    Each row's SHA-256 is cut into 24-bit words and every word is summed over all rows; the digest
    is the SHA-256 of the count and the sums. Sums combine on the map side, so no task ever holds
    more than eleven numbers per partition, and the 40 spare bits leave room for 2^39 rows.
    """
    names = sorted(columns or MANIFEST.fieldNames())
    row_hash = F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)
    starts = range(1, 65, _DIGEST_WORD)
    hashed = manifest.select(row_hash.alias("h"))
    words = [F.conv(F.substring("h", start, _DIGEST_WORD), 16, 10).cast("bigint") for start in starts]
    sums = [F.coalesce(F.sum(word), F.lit(0)).cast("string").alias(f"w{i}") for i, word in enumerate(words)]
    total = hashed.agg(F.count(F.lit(1)).alias("clip_count"), *sums)
    parts = [F.col("clip_count").cast("string"), *[F.col(f"w{i}") for i in range(len(words))]]
    return total.select("clip_count", F.sha2(F.concat_ws(":", *parts), 256).alias("manifest_sha256"))
