"""Clip bytes: direct reads by path, and whole-directory scans."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipmill import files_io, storage
from clipmill.functions.fields import clip_rel_path
from clipmill.operators.audio import map_rows, try_canonicalize_clips, try_canonicalize_files
from clipmill.operators.joins import missing_clips
from clipmill.operators.validate import ManifestProfile
from clipmill.shipping import ship

# A manifest up to this measured size is broadcast onto a scan of the clips directory.
BROADCAST_BYTES = 64 << 20
# ... unless many rows share one clip: the scan would emit them all from one task.
SHARED_CLIP_ROWS = 1_000
# Rows per task when clips are read by path.
CLIPS_PER_TASK = 2_000
# Names a listing task gives on at a time.
NAMES_PER_BATCH = 10_000

LISTED = "rel string, length long"


def read_clips(spark: SparkSession, clips_dir: str, pattern: str | None = "*.wav") -> DataFrame:
    """Every clip file below a directory: ``rel`` (path below it), ``length``, ``content``.

    Selecting only ``rel`` or ``length`` reads no file content. Paths come back unencoded, so the
    qualified root is cut off by length.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    root = storage.qualify(spark, clips_dir) + "/"
    rel = F.substr("path", F.lit(len(root) + 1))
    return reader.load(clips_dir).select(rel.alias("rel"), "length", "content")


def list_clips(spark: SparkSession, clips_dir: str, path: str) -> DataFrame:
    """The files below a directory, ``rel`` and ``length``, as a table written to ``path``.

    The directory is listed by jobs, a level of folders each: tasks list the folders of a level, and the
    folders they find are the next. Names stay in that table, so the driver holds no index of the files,
    however many there are; a folder is one task's work, which gives its names on in batches. Files are
    not opened. A folder that is not there has no files.
    """
    root = storage.qualify(spark, clips_dir)
    ship(spark)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                prefix = folder + "/" if folder else ""
                for some in batched(files_io.entries(root, folder), NAMES_PER_BATCH):
                    names, lengths = zip(*some)
                    rels = pa.array([prefix + name for name in names], pa.string())
                    yield pa.RecordBatch.from_arrays([rels, pa.array(lengths, pa.int64())], names=["rel", "length"])

    def level(number: int) -> DataFrame:
        return spark.read.schema(LISTED).parquet(storage.join(path, f"level={number}"))

    folders, n, number = spark.range(1).select(F.lit("").alias("rel")), int(storage.exists(spark, clips_dir)), 0
    while n:
        tasks = min(n, max(spark.sparkContext.defaultParallelism, -(-n // 100)))
        found = folders.repartition(tasks).mapInArrow(look, LISTED)
        found.write.parquet(storage.join(path, f"level={number}"))
        folders, number = level(number).where("length is null").select("rel"), number + 1
        n = folders.count()
    if not number:
        return spark.createDataFrame([], LISTED)
    return spark.read.schema(LISTED).parquet(path).where("length is not null").select("rel", "length")


def fetch_clips(rows: DataFrame, clips_dir: str, rel: str = "rel") -> DataFrame:
    """Add ``content``: each row's task opens the file itself, so only strings are ever shuffled."""
    root = storage.qualify(rows.sparkSession, clips_dir)
    made = T.StructType([T.StructField("content", T.BinaryType())])

    def read(row):
        return files_io.read_bytes(root, row[rel].as_py())

    def convert(row, raw):
        data = raw.result()
        return {"content": data}, len(data)

    return map_rows(rows, convert, (rel,), made, read=read)


def clip_lengths(rows: DataFrame, clips_dir: str, rel: str = "rel") -> DataFrame:
    """Add ``length``, null where the file does not exist, without reading it or listing a directory."""
    root = storage.qualify(rows.sparkSession, clips_dir)
    made = T.StructType([T.StructField("length", T.LongType())])

    def read(row):
        return files_io.length(root, row[rel].as_py())

    def convert(row, length):
        return {"length": length.result()}, 8

    return map_rows(rows, convert, (rel,), made, read=read)


def _raise_missing(missing: DataFrame, clips_dir: str) -> None:
    row = missing.agg(F.count(F.lit(1)).alias("n"), F.min("rel").alias("rel")).head()
    if row.n:
        raise FileNotFoundError(f"{row.n} clip(s) of the manifest are missing, such as {clips_dir}/{row.rel}")


def scan_may_broadcast(manifest: DataFrame, profile: ManifestProfile) -> bool:
    """Whether broadcasting the manifest onto a directory scan is safe: measured, not guessed."""
    if profile.text_bytes > BROADCAST_BYTES:
        return False
    shared = manifest.groupBy("clip_path").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).head()
    return shared.n <= SHARED_CLIP_ROWS


def _choose(spark: SparkSession, clips_dir: str, how: str) -> str:
    if how not in ("auto", "by_path", "scan"):
        raise ValueError(f"how is 'auto', 'by_path' or 'scan', not {how!r}")
    if how != "auto":
        return how
    return "by_path" if files_io.can_open(storage.qualify(spark, clips_dir)) else "scan"


def _rows_by_path(manifest: DataFrame, clips_dir: str, profile: ManifestProfile) -> DataFrame:
    """Manifest rows with ``rel``, spread over tasks of bounded size, after a look at every file.

    Rows that share a clip are spread like any others.
    """
    spark = manifest.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-profile.total // CLIPS_PER_TASK))
    rows = manifest.withColumn("rel", clip_rel_path(F.col("clip_path"))).repartition(tasks)
    # Cheap existence pass first, so no audio is decoded for an export that is incomplete.
    _raise_missing(clip_lengths(rows.select("rel"), clips_dir).where("length is null"), clips_dir)
    return rows


def _scan(manifest: DataFrame, clips_dir: str, profile: ManifestProfile) -> DataFrame:
    clips = read_clips(manifest.sparkSession, clips_dir, pattern=None)
    _raise_missing(missing_clips(manifest, clips), clips_dir)
    rows = manifest.withColumn("rel", clip_rel_path(F.col("clip_path")))
    if scan_may_broadcast(manifest, profile):
        rows = F.broadcast(rows)
    return clips.select("rel", "content").join(rows, "rel").drop("rel")


def attach_clips(
    spark: SparkSession, manifest: DataFrame, clips_dir: str, profile: ManifestProfile, how: str = "auto"
) -> DataFrame:
    """Manifest rows with the ``content`` of their clips; a missing clip is an error naming it.

    ``by_path`` spreads the manifest rows over tasks that open their clips themselves, so that only
    strings move between tasks, however large the manifest or however many rows share a clip.
    ``scan`` reads the whole directory through Spark and joins the manifest onto it, broadcast when
    its measured size allows. ``auto`` opens by path wherever the workers can.
    """
    if _choose(spark, clips_dir, how) == "scan":
        return _scan(manifest, clips_dir, profile)
    return fetch_clips(_rows_by_path(manifest, clips_dir, profile), clips_dir).drop("rel")


def canonical_clips(
    spark: SparkSession, manifest: DataFrame, clips_dir: str, profile: ManifestProfile, how: str = "auto"
) -> DataFrame:
    """Manifest rows with canonical ``bytes`` or an ``error``. By path, reading and converting are
    one step, and source bytes never leave the Python worker."""
    if _choose(spark, clips_dir, how) == "scan":
        return try_canonicalize_clips(_scan(manifest, clips_dir, profile))
    return try_canonicalize_files(_rows_by_path(manifest, clips_dir, profile), clips_dir)
