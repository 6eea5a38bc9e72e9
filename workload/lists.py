"""Queries of the composed listings, over whole tables and by page."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipmill.plans import listings
from workload.display import LABEL_TEXT_SQL, TRANSCRIPT_TEXT_SQL, _clean_sql
from workload.registry import query
from workload.tables import oracle


def _cut(column: str, n: int) -> str:
    return f"case when length({column}) > {n} then left({column}, {n - 1}) || '…' else {column} end"


_ANNOTATION_ROWS = f"""
    select id, left(id, 8) id_text, {_cut("coalesce(file_name, '-')", 24)} file_text, {LABEL_TEXT_SQL} label_text,
           printf('%.1f–%.1fs', start_sec, end_sec) range_text, coalesce(review_status, '—') review_text,
           {TRANSCRIPT_TEXT_SQL} transcript_text
    from (select a.*, f.name file_name, {_clean_sql("t.asr_text")} clean from from_source a
          left join files f on f.id = a.file_id left join transcripts t on t.id = a.id)"""

_VIEWS = ("annotations", "files", "transcripts")


@query("annotation_rows", oracle(_ANNOTATION_ROWS.replace("from_source", "annotations"), *_VIEWS))
def _(t):
    return listings.list_annotations(t.annotations, t.files, t.transcripts, page=None)


@query(
    "list_annotations",
    oracle(
        _ANNOTATION_ROWS.replace("from_source", "chosen"),
        *_VIEWS,
        chosen="select * from annotations where label_key = 'continuation' order by created_at, id limit 20 offset 20",
    ),
)
def _(t):
    return listings.list_annotations(t.annotations, t.files, t.transcripts, page=2, label="continuation")


_FILE_ROWS = f"""
    select f.id, {_cut("f.name", 32)} name_text, printf('%.1fs', f.duration_sec) duration_text,
           count(a.id) annotation_count,
           case when f.test_reserved_at is not null then 'reserved' else '—' end test_text
    from from_source f left join annotations a on a.file_id = f.id
    group by f.id, f.name, f.duration_sec, f.test_reserved_at"""


@query("file_rows", oracle(_FILE_ROWS.replace("from_source", "files"), "files", "annotations"))
def _(t):
    return listings.list_files(t.files, t.annotations, page=None)


@query(
    "list_files",
    oracle(
        _FILE_ROWS.replace("from_source", "chosen"),
        "files",
        "annotations",
        chosen="select * from files where test_reserved_at is not null order by name, id limit 30 offset 0",
    ),
)
def _(t):
    return listings.list_files(t.files, t.annotations, page=1, page_size=30, test_reserved=True)


_STATS = "select export_id, count(*) clip_count, cast(sum(length) as bigint) total_bytes from export_clips group by 1"
_EXPORT_ROWS = f"""
    select e.id, {_cut("e.name", 32)} name_text, e.status, coalesce(cast(s.clip_count as varchar), '—') clips_text,
           u.login created_by_login, e.error_message
    from from_source e left join stats s on s.export_id = e.id left join users u on u.id = e.created_by"""


@query("export_rows", oracle(_EXPORT_ROWS.replace("from_source", "exports"), "exports", "export_clips", "users", stats=_STATS))
def _(t):
    return listings.list_exports(t.exports, t.export_clips, t.users, page=None).drop("created_at")


@query(
    "list_exports",
    oracle(
        _EXPORT_ROWS.replace("from_source", "chosen"),
        "exports",
        "export_clips",
        "users",
        stats=_STATS,
        chosen="select * from exports order by created_at, id limit 20 offset 20",
    ),
)
def _(t):
    return listings.list_exports(t.exports, t.export_clips, t.users, page=2).drop("created_at")


_SIZE = """case when total_bytes < 1024 then concat(total_bytes, ' B')
                when total_bytes < 1048576 then printf('%.1f KB', total_bytes / 1024.0::DOUBLE)
                else printf('%.1f MB', total_bytes / 1048576.0::DOUBLE) end"""
_SHOW = f"""
    select e.id, e.name, case when trim(e.description) <> '' then e.description end description, e.project_id, e.status, s.clip_count,
           case when s.total_bytes is not null then {_SIZE} end bytes_text, e.error_message, u.login created_by_login
    from exports e left join stats s on s.export_id = e.id left join users u on u.id = e.created_by where_clause"""


@query("show_exports", oracle(_SHOW.replace("where_clause", ""), "exports", "export_clips", "users", stats=_STATS))
def _(t):
    return listings.show_exports(t.exports, t.export_clips, t.users).drop("created_at")


@query("show_export", oracle(_SHOW.replace("where_clause", "where e.id = '77'"), "exports", "export_clips", "users", stats=_STATS))
def _(t):
    return listings.show_export(t.exports, t.export_clips, t.users, "77").drop("created_at")


@query(
    "list_projects",
    oracle(f"select id, {_cut('name', 28)} name_text, created_at from projects order by name, id limit 10 offset 10", "projects"),
)
def _(t):
    return listings.list_projects(t.projects, page=2, page_size=10)


@query(
    "list_annotations_of_project",
    oracle(
        _ANNOTATION_ROWS.replace("from_source", "chosen"),
        *_VIEWS,
        chosen="""select * from annotations where file_id in (select id from files where project_id = 'p3')
                  order by created_at, id limit 20 offset 20""",
    ),
)
def _(t):
    return listings.list_annotations(t.annotations, t.files, t.transcripts, "p3", page=2)


@query(
    "list_files_of_project",
    oracle(
        _FILE_ROWS.replace("from_source", "chosen"),
        "files",
        "annotations",
        chosen="select * from files where project_id = 'p3' order by name, id limit 20",
    ),
)
def _(t):
    return listings.list_files(t.files, t.annotations, "p3")


@query(
    "list_exports_of_project",
    oracle(
        _EXPORT_ROWS.replace("from_source", "chosen"),
        "exports",
        "export_clips",
        "users",
        stats=_STATS,
        chosen="select * from exports where project_id = 'p3' order by created_at, id limit 20",
    ),
)
def _(t):
    return listings.list_exports(t.exports, t.export_clips, t.users, "p3").drop("created_at")


@query(
    "show_projects",
    oracle(
        """select id, name, case when active_label_set_id is not null then ' about ' || name || ' ' end description, created_at,
                  '-' updated_at, active_label_set_id label_set, 'user' as "role" from projects""",
        "projects",
    ),
)
def _(t):
    detail = F.to_json(
        F.struct(
            "id",
            "name",
            F.when(F.col("active_label_set_id").isNotNull(), F.concat(F.lit(" about "), "name", F.lit(" ")))
            .otherwise(F.lit(" \t "))
            .alias("description"),
            F.col("created_at").alias("createdAt"),
            F.col("active_label_set_id").alias("activeLabelSetId"),
            F.lit("user").alias("role"),
        )
    )
    return listings.show_projects(t.projects.select(detail.alias("detail")))
