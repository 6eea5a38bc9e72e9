"""Table changes. Each returns a new DataFrame; the caller writes it as a new version."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _id_table(like: DataFrame, ids: DataFrame | Iterable) -> DataFrame:
    """Distinct ids as a one-column table, from a DataFrame or a plain list."""
    if isinstance(ids, DataFrame):
        return ids.select("id").distinct()
    kind = like.schema["id"].dataType.simpleString()
    rows = [(i,) for i in dict.fromkeys(ids)]
    return like.sparkSession.createDataFrame(rows, f"id {kind}")


def _set_reservation(files: DataFrame, ids, change) -> tuple[DataFrame, DataFrame]:
    chosen = _id_table(files, ids)
    hit = F.coalesce("_hit", F.lit(False))
    changed = (
        files.join(chosen.withColumn("_hit", F.lit(True)), "id", "left")
        .withColumn("test_reserved_at", F.when(hit, change).otherwise(F.col("test_reserved_at")))
        .select(files.columns)
    )
    # Only the named ids of the files table survive the semi join.
    known = files.select("id").join(chosen, "id", "left_semi").withColumn("_known", F.lit(True))
    status = F.when(F.col("_known"), F.lit("ok")).otherwise(F.lit("not_found"))
    outcomes = chosen.join(known, "id", "left").select("id", status.alias("status"))
    return changed, outcomes


def reserve_files(files: DataFrame, ids: DataFrame | Iterable, at: str | Column) -> tuple[DataFrame, DataFrame]:
    """Hold files out for testing: new files table and one outcome per id.

    Idempotent: a file already reserved keeps its time. Unknown ids do not stop the others.
    """
    stamp = F.lit(at) if isinstance(at, str) else at
    return _set_reservation(files, ids, F.coalesce("test_reserved_at", stamp))


def unreserve_files(files: DataFrame, ids: DataFrame | Iterable) -> tuple[DataFrame, DataFrame]:
    """Clear the reservation: new files table and one outcome per id."""
    return _set_reservation(files, ids, F.lit(None).cast("string"))


def require_all_ok(outcomes: DataFrame) -> None:
    """A run with any failed id counts as failed."""
    bad = outcomes.where(F.col("status") != "ok").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).head()
    if bad.n:
        raise LookupError(f"{bad.n} file id(s) not found, such as {bad.id!r}")


def soft_delete_exports(
    exports: DataFrame, ids: DataFrame | Iterable, at: Column, confirm: bool = False
) -> DataFrame:
    """Mark exports as deleted; their clips stay until purged. Needs ``confirm=True``."""
    if not confirm:
        raise PermissionError("deleting exports needs confirm=True")
    before = F.col("deleted_at") if "deleted_at" in exports.columns else F.lit(None).cast("timestamp")
    hits = _id_table(exports, ids).withColumn("_hit", F.lit(True))
    return (
        exports.withColumn("deleted_at", before)
        .join(hits, "id", "left")
        .withColumn("deleted_at", F.when(F.col("_hit"), F.coalesce("deleted_at", at)).otherwise(F.col("deleted_at")))
        .drop("_hit")
    )


def purge_candidates(exports: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Deleted exports whose grace time is over."""
    return exports.where(F.col("deleted_at") <= now - F.make_dt_interval(days=F.lit(days)))
