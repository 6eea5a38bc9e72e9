"""Catalogue listings: whole tables, or one page of them, with display columns alongside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmill import storage
from clipmill.functions import text
from clipmill.functions.fields import json_texts
from clipmill.operators.aggregates import annotation_counts, with_export_stats
from clipmill.operators.filters import filter_annotations, filter_files
from clipmill.operators.joins import annotations_with_files, exports_with_creator, of_project
from clipmill.operators.paging import page as page_of
from clipmill.schemas import DEFAULT_PAGE_SIZE

NOT_SET = "—"


def _paged(df: DataFrame, page: int | None, page_size: int, order_by) -> DataFrame:
    """The page, or with ``page=None`` the whole table unordered.

    A page is looked up at once and kept in the shared folder: the tables joined to it would otherwise
    each sort the listing again.
    """
    if page is None:
        return df
    return storage.checkpointed(page_of(df, page, page_size, order_by))


def _in_project(df: DataFrame, project_id: str | None) -> DataFrame:
    return df if project_id is None else df.where(F.col("project_id") == project_id)


def _for_page(lookup: DataFrame, key: str, chosen: DataFrame, chosen_key: str) -> DataFrame:
    """The lookup rows a page needs, so that big tables are filtered before they are joined."""
    keys = chosen.select(F.col(chosen_key).alias(key)).distinct()
    # The page is one task's rows already, so its keys may go to every task.
    return lookup.join(F.broadcast(keys), key, "left_semi")


def list_annotations(
    annotations: DataFrame,
    files: DataFrame,
    transcripts: DataFrame,
    project_id: str | None = None,
    page: int | None = 1,
    page_size: int = DEFAULT_PAGE_SIZE,
    order_by=("created_at",),
    **filters,
) -> DataFrame:
    """Short id, file, label, range, review status and transcript of each annotation."""
    matching = filter_annotations(annotations, **filters)
    if project_id is not None:
        matching = of_project(matching, files, project_id)
    chosen = _paged(matching, page, page_size, order_by)
    if page is not None:
        files = _for_page(files, "id", chosen, "file_id")
        transcripts = _for_page(transcripts, "id", chosen, "id")
    # Transcripts are cut before they are joined, so that long texts are not shuffled.
    shown = text.truncate_width(text.clean_text(F.col("asr_text")), 80)
    joined = annotations_with_files(chosen, files, transcripts.select("id", shown.alias("asr_text")), plain=page is not None)
    return joined.select(
        "id",
        text.short_id(F.col("id")).alias("id_text"),
        text.truncate_chars(text.or_dash(F.col("file_name")), 24).alias("file_text"),
        text.label_text(F.col("label_key"), F.col("label_value")).alias("label_text"),
        text.time_range(F.col("start_sec"), F.col("end_sec")).alias("range_text"),
        text.or_dash(F.col("review_status"), NOT_SET).alias("review_text"),
        F.col("asr_text").alias("transcript_text"),
    )


def list_files(
    files: DataFrame,
    annotations: DataFrame,
    project_id: str | None = None,
    page: int | None = 1,
    page_size: int = DEFAULT_PAGE_SIZE,
    order_by=("name",),
    **filters,
) -> DataFrame:
    """Id, name, duration, annotation count and reservation mark of each file."""
    chosen = _paged(filter_files(_in_project(files, project_id), **filters), page, page_size, order_by)
    if page is not None:
        annotations = _for_page(annotations, "file_id", chosen, "id")
    reserved = F.when(F.col("test_reserved_at").isNotNull(), F.lit("reserved"))
    return annotation_counts(chosen, annotations).select(
        "id",
        text.truncate_chars(F.col("name"), 32).alias("name_text"),
        text.seconds_text(F.col("duration_sec")).alias("duration_text"),
        "annotation_count",
        text.or_dash(reserved, NOT_SET).alias("test_text"),
    )


def list_exports(
    exports: DataFrame,
    clips: DataFrame,
    users: DataFrame,
    project_id: str | None = None,
    page: int | None = 1,
    page_size: int = DEFAULT_PAGE_SIZE,
    order_by=("created_at",),
) -> DataFrame:
    """Id, name, status, clip count, creator and any error of each export."""
    chosen = _paged(_in_project(exports, project_id), page, page_size, order_by)
    if page is not None:
        clips = _for_page(clips, "export_id", chosen, "id")
    full = exports_with_creator(with_export_stats(chosen, clips), users)
    return full.select(
        "id",
        text.truncate_chars(F.col("name"), 32).alias("name_text"),
        "status",
        text.or_dash(F.col("clip_count"), NOT_SET).alias("clips_text"),
        F.col("created_at"),
        "created_by_login",
        "error_message",
    )


def show_exports(exports: DataFrame, clips: DataFrame, users: DataFrame) -> DataFrame:
    """The summary of each export given, one row per export; absent values are null."""
    full = exports_with_creator(with_export_stats(exports, clips), users)
    optional = [c for c in ("filter", "split_policy", "manifest_sha256", "ready_at") if c in full.columns]
    description = F.col("description") if "description" in full.columns else F.lit(None).cast("string")
    return full.select(
        "id",
        "name",
        text.unless_blank(description).alias("description"),
        "project_id",
        "status",
        "clip_count",
        text.human_bytes(F.col("total_bytes")).alias("bytes_text"),
        "created_at",
        "error_message",
        "created_by_login",
        *optional,
    )


def show_export(exports: DataFrame, clips: DataFrame, users: DataFrame, export_id: str) -> DataFrame:
    wanted = F.col("id") == export_id
    return show_exports(exports.where(wanted), clips.where(F.col("export_id") == export_id), users)


def list_projects(
    projects: DataFrame, page: int | None = 1, page_size: int = DEFAULT_PAGE_SIZE, order_by=("name",)
) -> DataFrame:
    return _paged(projects, page, page_size, order_by).select(
        "id", text.truncate_chars(F.col("name"), 28).alias("name_text"), "created_at"
    )


def show_projects(details: DataFrame, document: str = "detail") -> DataFrame:
    """Summary of project details kept as JSON text; label set and role are optional."""

    names = {"id": "-", "name": "-", "description": None, "createdAt": "-", "updatedAt": "-"}
    parsed = details.select(json_texts(F.col(document), names | {"activeLabelSetId": None, "role": None}).alias("p"))
    return parsed.select(
        "p.id",
        "p.name",
        text.unless_blank(F.col("p.description")).alias("description"),
        F.col("p.createdAt").alias("created_at"),
        F.col("p.updatedAt").alias("updated_at"),
        F.col("p.activeLabelSetId").alias("label_set"),
        "p.role",
    )
