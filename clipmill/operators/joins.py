"""Lookups between catalogue tables.

The lookup side is unique on its key. Small lookups are left to Spark, which broadcasts them when
its statistics are below ``spark.sql.autoBroadcastJoinThreshold``. Otherwise, since one source file
or creator can hold a large share of the rows, the rows of hot keys are spread over salts, so that a
hot key never ends up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmill.functions.fields import clip_rel_path

# A key is hot with more than this share of the rows; there can be no more than a thousand such keys.
HOT_SHARE = 0.001


def spread_lookup(
    rows: DataFrame, lookup: DataFrame, key: str, spread_by: str, how: str = "left", plain: bool = False
) -> DataFrame:
    """Join of ``rows`` to ``lookup`` (unique on ``key``) that tolerates hot keys.

    Rows are counted per key first, combining on the map side. Rows of a hot key get a salt from a
    hash of their ``spread_by`` column, and the key's lookup row is repeated for each salt; all other
    rows keep one salt. A lookup that Spark can broadcast, or one the caller knows to be small
    (``plain``), is joined as it is.
    """
    if plain or fits_broadcast(lookup):
        return rows.join(lookup, key, how)
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    hot = counts.where(F.col("_n") > total * HOT_SHARE).select(key, F.lit(True).alias("_hot"))
    hot = F.broadcast(hot)  # 1 / HOT_SHARE keys at most

    salt = F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")
    # Null keys find nothing, wherever they go.
    spread = F.col("_hot") | F.col(key).isNull()
    salted = rows.join(hot, key, "left").withColumn("_salt", F.when(spread, salt).otherwise(F.lit(0))).drop("_hot")
    all_salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = lookup.join(hot, key, "left").withColumn("_salt", F.explode(all_salts)).drop("_hot")
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")


def fits_broadcast(df: DataFrame) -> bool:
    """Whether the optimizer's size estimate is below Spark's broadcast threshold."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    estimate = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return 0 <= int(str(estimate)) <= limit


def plan_fetch(manifest: DataFrame, present: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Manifest rows still to fetch and rows already there; ``force`` fetches all.

    ``present`` lists annotation ids, the names of the clip files on hand.
    """
    if force:
        return manifest, manifest.limit(0)
    ids = present.select("annotation_id")
    return manifest.join(ids, "annotation_id", "left_anti"), manifest.join(ids, "annotation_id", "left_semi")


def missing_clips(manifest: DataFrame, clips: DataFrame) -> DataFrame:
    """Clip paths the manifest names but that are not on hand, with the rows naming them.

    Only paths take part, never clip bytes, and rows sharing a clip are counted before the join.
    """
    wanted = manifest.groupBy(clip_rel_path(F.col("clip_path")).alias("rel")).agg(
        F.count(F.lit(1)).alias("manifest_rows")
    )
    return wanted.join(clips.select("rel"), "rel", "left_anti")


def annotations_with_files(
    annotations: DataFrame, files: DataFrame, transcripts: DataFrame, plain: bool = False
) -> DataFrame:
    """File name and transcript next to each annotation, null where there is none."""
    names = files.select(F.col("id").alias("file_id"), F.col("name").alias("file_name"))
    texts = transcripts.select("id", "asr_text")
    return spread_lookup(annotations, names, "file_id", "id", plain=plain).join(texts, "id", "left")


def exports_with_creator(exports: DataFrame, users: DataFrame) -> DataFrame:
    """Creator's login next to each export, null for unknown users."""
    logins = users.select(F.col("id").alias("created_by"), F.col("login").alias("created_by_login"))
    return spread_lookup(exports, logins, "created_by", "id")


def resolve_label_set(projects: DataFrame, project_id: str, explicit: str | None = None) -> str:
    """The explicit label set, else the project's active one."""
    if explicit is not None:
        return explicit
    found = projects.where(F.col("id") == project_id).select("active_label_set_id").head()
    if found is None:
        raise LookupError(f"project {project_id} not found")
    if found.active_label_set_id is None:
        raise ValueError("project has no active label set; give a label set id")
    return found.active_label_set_id


def resolve_label_sets(requests: DataFrame, projects: DataFrame) -> DataFrame:
    """Bulk form: ``requests(id, project_id, label_set_id?)`` gain the label set that applies."""
    active = projects.select(F.col("id").alias("project_id"), "active_label_set_id")
    return spread_lookup(requests, active, "project_id", "id").withColumn(
        "resolved_label_set_id", F.coalesce("label_set_id", "active_label_set_id")
    )


def of_project(annotations: DataFrame, files: DataFrame, project_id: str) -> DataFrame:
    """The annotations of a project's files."""
    ids = files.where(F.col("project_id") == project_id).select(F.col("id").alias("file_id"))
    return spread_lookup(annotations, ids, "file_id", "id", how="left_semi")


def reserved_file_ids(files: DataFrame) -> DataFrame:
    return files.where(F.col("test_reserved_at").isNotNull()).select(F.col("id").alias("file_id"))


def mark_reserved(annotations: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``reserved``: whether the row's source file is held out for testing."""
    held_out = reserved_file_ids(files).withColumn("_hit", F.lit(True))
    marked: Column = F.coalesce("_hit", F.lit(False))
    return spread_lookup(annotations, held_out, "file_id", "id").withColumn("reserved", marked).drop("_hit")
