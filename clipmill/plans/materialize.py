"""Bringing an export's clips to a directory, continuing where an earlier run stopped."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import ExitStack
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipmill import files_io, storage
from clipmill.functions.fields import clip_rel_path
from clipmill.operators.audio import map_rows
from clipmill.operators.filters import require_ready
from clipmill.sinks.manifest import write_manifest
from clipmill.sources.clips import CLIPS_PER_TASK, clip_lengths, list_clips

# Where an export keeps which clips it has brought, a folder ``run=<number>`` for each run.
LEDGER = "copied"
ENTRY = "rel string, digest string, length long, copied boolean"


@dataclass(frozen=True)
class MaterializeResult:
    total: int
    skipped: int
    downloaded: int
    bytes: int


def write_clips(
    rows: DataFrame,
    clips_dir: str,
    rel: str = "rel",
    content: str = "content",
    make: Callable[[dict], bytes] | None = None,
    inputs: tuple[str, ...] = (),
) -> DataFrame:
    """Write each row's ``content`` below a directory; gives back the other columns with ``written`` bytes.

    With ``make``, a clip's bytes are made of the columns ``inputs`` (not given back) by the worker that writes
    them: a step before this one that makes them would hold a second worker for every task.

    Lazy: the files appear when the result is computed. A file is complete under its final name or
    not there at all, and writing it again gives the same file, so lost tasks can be repeated.
    """
    root = storage.qualify(rows.sparkSession, clips_dir)
    made = T.StructType([T.StructField("written", T.LongType())])

    def convert(row):
        data = make(row) if make else row[content].as_buffer()
        files_io.write_bytes(root, row[rel].as_py(), data)
        return {"written": len(data)}, 8

    used = inputs if make else (content,)
    return map_rows(rows, convert, (rel, *used), made, drop=used)


def copy_clips(rows: DataFrame, source_dir: str, clips_dir: str, rel: str = "rel") -> DataFrame:
    """Copy files named by ``rel`` between directories, in pieces, a few files at a time per task."""
    spark = rows.sparkSession
    source, target = storage.qualify(spark, source_dir), storage.qualify(spark, clips_dir)
    made = T.StructType([T.StructField("written", T.LongType())])

    def read(row):
        return files_io.copy(source, target, row[rel].as_py())

    def convert(row, copied):
        return {"written": copied.result()}, 8

    return map_rows(rows, convert, (rel,), made, read=read)


def materialize(
    spark: SparkSession,
    exports: DataFrame,
    export_id: str,
    manifest: DataFrame,
    source_clips: str,
    out_dir: str,
    force: bool = False,
) -> MaterializeResult:
    """Write ``manifest.jsonl`` and copy every clip that is not there yet into ``clips/``.

    A ledger in ``copied`` beside the clips says which clips are known: their digest in the manifest and
    their length, as a table that every run adds to. A known clip is present when ``clips/`` lists it with
    that length, so a finished export resumes from the ledger and a listing, without a look at the source
    or at single files. Clips the ledger does not know (or knows with another digest), or that are
    missing or cut short, are looked up one by one on both sides: of equal length they are present, too,
    and enter the ledger. ``force`` copies all again. Only names, digests and lengths move through Spark;
    bytes go from storage to storage.
    """
    require_ready(exports, export_id)
    clips_dir = storage.join(out_dir, "clips")
    storage.make_dirs(spark, clips_dir)
    with storage.staged(manifest, "manifest") as rows:
        write_manifest(rows, out_dir)
        clips = rows.select(clip_rel_path(F.col("clip_path")).alias("rel"), "clip_sha256").groupBy("rel")
        # Rows that share a clip copy it once.
        clips = clips.agg(F.count("*").alias("rows"), F.max("clip_sha256").alias("digest"))
        return _copy_pending(spark, clips, source_clips, clips_dir, storage.join(out_dir, LEDGER), force)


def _known(spark: SparkSession, ledger: str, clips_dir: str, listing: str) -> DataFrame:
    """``rel, digest`` of the clips that the ledger's last entry for them and the directory agree on."""
    entries = spark.read.schema(ENTRY + ", run long").parquet(ledger)
    last = entries.groupBy("rel").agg(F.max_by(F.struct("digest", "length"), "run").alias("last"))
    return last.select("rel", "last.*").join(list_clips(spark, clips_dir, listing), ["rel", "length"]).drop("length")


def _copy_pending(
    spark: SparkSession, clips: DataFrame, source_clips: str, clips_dir: str, ledger: str, force: bool
) -> MaterializeResult:
    with ExitStack() as open_:
        clips = open_.enter_context(storage.staged(clips, "clips"))
        runs = len([n for n in storage.names(spark, ledger) if n.startswith("run=")])
        unknown = clips
        if runs and not force:
            listing = storage.scratch_dir(spark, "listing")
            open_.callback(storage.remove, spark, listing)
            unknown = clips.join(_known(spark, ledger, clips_dir, listing), ["rel", "digest"], "left_anti")
        unknown = open_.enter_context(storage.staged(unknown, "unknown"))
        total, n = clips.agg(F.sum("rows")).head()[0] or 0, unknown.count()
        if not n:
            return MaterializeResult(total, total, 0, 0)
        tasks = max(spark.sparkContext.defaultParallelism, -(-n // CLIPS_PER_TASK))
        sized = clip_lengths(unknown.repartition(tasks), source_clips).withColumnRenamed("length", "source_length")
        here = F.lit(False) if force else F.col("length").eqNullSafe(F.col("source_length"))
        # The plan is written down first: copying changes what a recomputed look at the files would see.
        # Names are dealt anew between the two looks: in one stage they would hold two workers for every task.
        sized = clip_lengths(sized.repartition(tasks), clips_dir).withColumn("here", here)
        plan = open_.enter_context(storage.staged(sized, "materialize"))
        seen = plan.agg(
            F.coalesce(F.sum(F.when(~F.col("here"), F.col("rows"))), F.lit(0)).alias("pending"),
            F.count_if(F.col("source_length").isNull()).alias("lost"),
            F.min(F.when(F.col("source_length").isNull(), F.col("rel"))).alias("lost_rel"),
        ).head()
        if seen.lost:
            raise FileNotFoundError(f"{seen.lost} source clip(s) are missing, such as {source_clips}/{seen.lost_rel}")
        found = plan.where("here").select("rel", "digest", F.col("source_length").alias("length"), F.lit(False).alias("copied"))
        pending = plan.where("not here").select("rel", "digest").repartition(tasks)
        copied = copy_clips(pending, source_clips, clips_dir).withColumnRenamed("written", "length")
        # Copying is what computes these entries, so an entry is there only for a clip that is.
        entries = found.unionByName(copied.withColumn("copied", F.lit(True)))
        made = storage.join(ledger, f"run={runs}")
        entries.write.mode("overwrite").parquet(made)
        size = spark.read.schema(ENTRY).parquet(made).where("copied").agg(F.sum("length")).head()[0] or 0
        return MaterializeResult(total, total - seen.pending, seen.pending, size)
