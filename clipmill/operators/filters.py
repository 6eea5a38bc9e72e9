"""Row filters of the catalogue listings and of an export."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipmill.spec import ExportSpec

UNREVIEWED = "unreviewed"


def _where_all(df: DataFrame, predicates: list[Column]) -> DataFrame:
    return df.where(reduce(and_, predicates)) if predicates else df


def review_status_is(statuses) -> Column:
    """Rows in one of the statuses; ``unreviewed`` also covers rows that carry none."""
    status = F.col("review_status")
    wanted = status.isin(list(statuses))
    return wanted | status.isNull() if UNREVIEWED in statuses else wanted


def filter_annotations(
    df: DataFrame,
    label: str | None = None,
    review_status: str | None = None,
    file_id: str | None = None,
    created_by: int | None = None,
) -> DataFrame:
    """Annotations matching every given value; ``None`` does not restrict."""
    predicates = []
    if label is not None:
        predicates.append(F.col("label_key") == label)
    if review_status is not None:
        predicates.append(review_status_is([review_status]))
    if file_id is not None:
        predicates.append(F.col("file_id") == file_id)
    if created_by is not None:
        predicates.append(F.col("created_by") == created_by)
    return _where_all(df, predicates)


def _comparable(df: DataFrame, bound: str) -> tuple[Column, Column]:
    """``created_at`` and an RFC 3339 bound in one type. Zone-less values count as UTC."""
    at = datetime.fromisoformat(bound)
    at = at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at.astimezone(timezone.utc)
    created, kind = F.col("created_at"), df.schema["created_at"].dataType
    if isinstance(kind, T.TimestampNTZType):
        return created, F.lit(at.replace(tzinfo=None).isoformat(" ")).cast(kind)
    if isinstance(kind, T.StringType):  # a zone is Z or an offset behind a time of day
        zoned, timed = created.rlike(r"[T ].*(Z|[+-]\d{2}:?\d{2})\s*$"), created.rlike("[T ]")
        utc = F.concat(created, F.when(timed, F.lit("Z")).otherwise(F.lit("T00:00:00Z")))
        created = F.when(zoned, created).otherwise(utc)
    return created.cast("timestamp"), F.lit(at.isoformat()).cast("timestamp")


def filter_export(df: DataFrame, spec: ExportSpec, label_set_id: str | None = None) -> DataFrame:
    """Annotations an export takes in. Both time bounds are inclusive."""
    predicates = [review_status_is(spec.statuses)]
    label_set = label_set_id or spec.label_set_id
    if label_set is not None:
        predicates.append(F.col("label_set_id") == label_set)
    if spec.label_keys:
        predicates.append(F.col("label_key").isin(list(spec.label_keys)))
    if spec.labeller_ids:
        predicates.append(F.col("created_by").isin(list(spec.labeller_ids)))
    if spec.created_at_from is not None:
        created, bound = _comparable(df, spec.created_at_from)
        predicates.append(created >= bound)
    if spec.created_at_to is not None:
        created, bound = _comparable(df, spec.created_at_to)
        predicates.append(created <= bound)
    return _where_all(df, predicates)


def filter_files(df: DataFrame, q: str | None = None, test_reserved: bool | None = None) -> DataFrame:
    """Files whose name holds ``q`` in any case (``%`` and ``_`` are plain), reserved or not."""
    predicates = []
    if q is not None:
        predicates.append(F.contains(F.lower("name"), F.lower(F.lit(q))))
    if test_reserved is not None:
        at = F.col("test_reserved_at")
        predicates.append(at.isNotNull() if test_reserved else at.isNull())
    return _where_all(df, predicates)


def ready_exports(exports: DataFrame) -> DataFrame:
    return exports.where(F.col("status") == "ready")


def require_ready(exports: DataFrame, export_id: str) -> DataFrame:
    """The one export, which must exist and be ready to materialise."""
    chosen = exports.where(F.col("id") == export_id)
    found = chosen.select("status").head()
    if found is None:
        raise LookupError(f"export {export_id} not found")
    if found.status != "ready":
        raise ValueError(f"export status is {found.status!r}; only 'ready' exports can be materialised")
    return chosen
