"""Queries of the relational operators: filters, joins, aggregates, splits, paging, changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipmill import ExportSpec, SplitPolicy, storage
from clipmill.operators import aggregates, changes, filters, joins, paging, splits, validate
from clipmill.plans.freeze import manifest_rows
from clipmill.schemas import MANIFEST, required_fields
from workload.registry import query
from workload.tables import Tables, oracle

RATIOS = (0.8, 0.1, 0.1)
RESERVED_RATIOS = (0.9, 0.1, 0.0)


def uniform_sql(key: str, seed: int = 42) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT / 4294967296.0)"


def split_sql(key: str, seed: int = 42) -> str:
    u = uniform_sql(key, seed)
    return f"case when {u} < {RATIOS[0]!r} then 'train' when {u} < {RATIOS[0] + RATIOS[1]!r} then 'validation' else 'test' end"


MANIFEST_SQL = f"""
    select id annotation_id, concat('clips/', id, '.wav') clip_path, clip_sha256,
           end_sec - start_sec clip_duration_sec, clip_sample_rate, label_key, label_value,
           file_id source_file_id, source_file_sha256, created_by labeller_id, review_status,
           {split_sql("file_id")} split
    from annotations"""


def manifest(t: Tables):
    """Every annotation as a manifest row, split by source file."""
    return manifest_rows(splits.assign_split(t.annotations, SplitPolicy("by_source_file", 42, RATIOS)))


# ---- flagship -------------------------------------------------------------------------------


@query(
    "approved_clips_per_split",
    oracle(
        f"""select split, n, cast(sum(n) over () as bigint) total from (
              select {split_sql("file_id")} split, count(*) n from annotations
              where review_status = 'approved' group by 1)""",
        "annotations",
    ),
)
def approved_clips_per_split(t: Tables):
    spec = ExportSpec("p0", "approved", split=SplitPolicy("by_source_file", 42, RATIOS))
    approved = filters.filter_export(t.annotations, spec)
    return aggregates.split_counts(splits.assign_split(approved, spec.split))


# ---- filters --------------------------------------------------------------------------------


@query(
    "filter_annotations",
    oracle(
        """select id, file_id, label_key, review_status, created_by from annotations
           where label_key = 'end_of_turn' and (review_status is null or review_status = 'unreviewed')
             and created_by = 3""",
        "annotations",
    ),
)
def _(t):
    found = filters.filter_annotations(t.annotations, "end_of_turn", "unreviewed", created_by=3)
    return found.select("id", "file_id", "label_key", "review_status", "created_by")


@query(
    "filter_annotations_of_file",
    oracle(
        "select id, label_key, start_sec, end_sec from annotations where file_id = '7' and review_status = 'approved'",
        "annotations",
    ),
)
def _(t):
    found = filters.filter_annotations(t.annotations, review_status="approved", file_id="7")
    return found.select("id", "label_key", "start_sec", "end_sec")


@query(
    "filter_export",
    oracle(
        """select id, label_key, created_by, label_set_id from annotations
           where label_set_id = 'ls1' and review_status in ('approved', 'needs_fix')
             and label_key in ('end_of_turn', 'continuation') and created_by in (0, 1, 2, 3)
             and created_at >= timestamp '2024-01-02 00:00:00' and created_at <= timestamp '2024-01-20 12:00:00'""",
        "annotations",
    ),
)
def _(t):
    spec = ExportSpec(
        "p0",
        "two labels",
        label_set_id="ls1",
        review_statuses=("approved", "needs_fix"),
        label_keys=("end_of_turn", "continuation"),
        labeller_ids=(0, 1, 2, 3),
        created_at_from="2024-01-02T00:00:00Z",
        created_at_to="2024-01-20T14:00:00+02:00",
    )
    return filters.filter_export(t.annotations, spec).select("id", "label_key", "created_by", "label_set_id")


@query(
    "filter_files",
    oracle(
        "select id, name, project_id from files where contains(lower(name), 'omer#0000001') and test_reserved_at is null",
        "files",
    ),
)
def _(t):
    return filters.filter_files(t.files, q="OMER#0000001", test_reserved=False).select("id", "name", "project_id")


@query("filter_files_reserved", oracle("select id, name, test_reserved_at from files where test_reserved_at is not null", "files"))
def _(t):
    return filters.filter_files(t.files, test_reserved=True).select("id", "name", "test_reserved_at")


@query("ready_exports", oracle("select id, project_id, status from exports where status = 'ready'", "exports"))
def _(t):
    return filters.ready_exports(t.exports).select("id", "project_id", "status")


def _rule_sql(rule: str, broken: str, shown: str) -> str:
    return f"""select '{rule}' as "rule", count(*) filter (where {broken}) violations,
                      min({shown}) filter (where {broken}) sample from manifest"""


_RULES_SQL = [_rule_sql(f"{c} is missing", f"{c} is null", f"'{c}'") for c in required_fields(MANIFEST)] + [
    _rule_sql("unknown split", "split not in ('train', 'validation', 'test')", "split"),
    _rule_sql("unknown label", "label_key not in ('end_of_turn', 'continuation')", "label_key"),
]


@query("manifest_violations", oracle(" union all ".join(_RULES_SQL), "annotations", manifest=MANIFEST_SQL))
def _(t):
    return validate.manifest_violations(manifest(t))


# ---- joins ----------------------------------------------------------------------------------

# Clips on hand: one per document id.
PRESENT_SQL = "select cast(doc_id as string) annotation_id from documents"


def present(t: Tables):
    return t.transcripts.select(F.col("id").alias("annotation_id"))


@query(
    "missing_clips",
    oracle(
        """select concat(annotation_id, '.wav') rel, count(*) manifest_rows from manifest
           where annotation_id not in (select annotation_id from present) group by 1""",
        "annotations",
        manifest=MANIFEST_SQL,
        present=PRESENT_SQL,
    ),
)
def _(t):
    clips = present(t).select(F.concat("annotation_id", F.lit(".wav")).alias("rel"))
    return joins.missing_clips(manifest(t), clips)


for _kind, _not, _force in (("pending", "not", False), ("skipped", "", False), ("forced", None, True)):
    _where = "" if _force else f"where annotation_id {_not} in (select annotation_id from present)"

    @query(
        f"plan_fetch_{_kind}",
        oracle(
            f"select annotation_id, clip_path, split from manifest {_where}",
            "annotations",
            manifest=MANIFEST_SQL,
            present=PRESENT_SQL,
        ),
    )
    def _(t, kind=_kind, force=_force):
        pending, skipped = joins.plan_fetch(manifest(t), present(t), force)
        return (skipped if kind == "skipped" else pending).select("annotation_id", "clip_path", "split")


@query(
    "annotations_with_files",
    oracle(
        """select a.id, a.file_id, f.name file_name, length(t.asr_text) asr_chars from annotations a
           left join files f on f.id = a.file_id left join transcripts t on t.id = a.id""",
        "annotations",
        "files",
        "transcripts",
    ),
)
def _(t):
    joined = joins.annotations_with_files(t.annotations, t.files, t.transcripts)
    return joined.select("id", "file_id", "file_name", F.length("asr_text").cast("bigint").alias("asr_chars"))


@query(
    "exports_with_creator",
    oracle(
        """select e.id, e.created_by, u.login created_by_login from exports e left join users u on u.id = e.created_by""",
        "exports",
        "users",
    ),
)
def _(t):
    return joins.exports_with_creator(t.exports, t.users).select("id", "created_by", "created_by_login")


REQUESTS_SQL = "select id, project_id, case when status = 'failed' then 'ls9' end label_set_id from exports"


@query(
    "resolve_label_sets",
    oracle(
        """select r.id, r.project_id, coalesce(r.label_set_id, p.active_label_set_id) resolved_label_set_id
           from requests r left join projects p on p.id = r.project_id""",
        "exports",
        "projects",
        requests=REQUESTS_SQL,
    ),
)
def _(t):
    explicit = F.when(F.col("status") == "failed", F.lit("ls9")).alias("label_set_id")
    requests = t.exports.select("id", "project_id", explicit)
    return joins.resolve_label_sets(requests, t.projects).select("id", "project_id", "resolved_label_set_id")


@query(
    "mark_reserved",
    oracle(
        """select a.id, a.file_id, coalesce(f.test_reserved_at is not null, false) reserved
           from annotations a left join files f on f.id = a.file_id""",
        "annotations",
        "files",
    ),
)
def _(t):
    return joins.mark_reserved(t.annotations, t.files).select("id", "file_id", "reserved")


# ---- aggregates -----------------------------------------------------------------------------


@query(
    "split_counts",
    oracle(
        """select split, count(*) n, cast(sum(count(*)) over () as bigint) total from manifest group by split""",
        "annotations",
        manifest=MANIFEST_SQL,
    ),
)
def _(t):
    return aggregates.split_counts(manifest(t))


@query(
    "export_stats",
    oracle(
        """select e.id, s.clip_count, s.total_bytes from exports e left join (
             select export_id, count(*) clip_count, cast(sum(length) as bigint) total_bytes
             from export_clips group by 1) s on s.export_id = e.id""",
        "exports",
        "export_clips",
    ),
)
def _(t):
    return aggregates.with_export_stats(t.exports, t.export_clips).select("id", "clip_count", "total_bytes")


MICROS = "cast(round((end_sec - start_sec) * 1000000) as bigint)"


@query(
    "reservation_summary",
    oracle(
        f"""select f.project_id, count(distinct f.id) file_count, count(a.id) annotation_count,
                   cast(coalesce(sum({MICROS}), 0) as double) / 1000000 labelled_seconds
            from files f left join annotations a on a.file_id = f.id
            where f.test_reserved_at is not null group by 1""",
        "files",
        "annotations",
    ),
)
def _(t):
    return aggregates.reservation_summaries(t.files, t.annotations)


@query(
    "reservation_summary_of_project",
    oracle(
        f"""select (select count(*) from r) file_count, count(*) annotation_count,
                   cast(coalesce(sum({MICROS}), 0) as double) / 1000000 labelled_seconds
            from annotations where file_id in (select id from r)""",
        "files",
        "annotations",
        r="select id from files where project_id = 'p3' and test_reserved_at is not null",
    ),
)
def _(t):
    return aggregates.reservation_summary(t.files, t.annotations, "p3")


@query(
    "annotation_counts",
    oracle(
        """select f.id, count(a.id) annotation_count from files f left join annotations a on a.file_id = f.id group by 1""",
        "files",
        "annotations",
    ),
)
def _(t):
    return aggregates.annotation_counts(t.files, t.annotations).select("id", "annotation_count")


@query(
    "page_info",
    oracle(
        """select 2 page, 20 page_size, count(*) total, cast(ceil(count(*) / 20.0) as bigint) total_pages,
                  case when 2 < ceil(count(*) / 20.0) then 3 end next_page
           from annotations where review_status = 'approved'""",
        "annotations",
    ),
)
def _(t):
    return aggregates.page_info(filters.filter_annotations(t.annotations, review_status="approved"), 2, 20)


FINGERPRINT_COLUMNS = sorted(
    "annotation_id clip_path clip_sha256 clip_duration_sec clip_sample_rate label_key label_value source_file_id "
    "source_file_sha256 labeller_id review_status split".split()
)
_WORDS = ", ".join(
    f"cast(coalesce(sum(('0x' || substr(h, {s}, 6))::BIGINT), 0) as varchar)" for s in range(1, 65, 6)
)


# Over rows with their hash ``h``, as given by HASHED_SQL.
FINGERPRINT_SQL = f"sha256(concat_ws(':', cast(count(*) as varchar), {_WORDS}))"
HASHED_SQL = f"sha256(cast(to_json({{{', '.join(f"'{c}': {c}" for c in FINGERPRINT_COLUMNS)}}}) as varchar))"


@query(
    "manifest_fingerprint",
    oracle(
        f"""select count(*) clip_count, {FINGERPRINT_SQL} manifest_sha256 from (select {HASHED_SQL} h from manifest)""",
        "annotations",
        manifest=MANIFEST_SQL,
    ),
)
def _(t):
    return aggregates.manifest_fingerprint(manifest(t))


# ---- splits ---------------------------------------------------------------------------------

for _kind, _key in (("random", "id"), ("by_source_file", "file_id"), ("by_labeller", "cast(created_by as varchar)")):

    @query(f"split_{_kind}", oracle(f"select id, file_id, created_by, {split_sql(_key)} split from annotations", "annotations"))
    def _(t, kind=_kind):
        return splits.assign_split(t.annotations, SplitPolicy(kind, 42, RATIOS)).select(
            "id", "file_id", "created_by", "split"
        )


@query(
    "split_reserved",
    oracle(
        f"""select a.id, case when f.test_reserved_at is not null then 'test'
                              when {uniform_sql("a.file_id")} < {RESERVED_RATIOS[0]!r} then 'train'
                              else 'validation' end split
            from annotations a left join files f on f.id = a.file_id""",
        "annotations",
        "files",
    ),
)
def _(t):
    marked = joins.mark_reserved(t.annotations, t.files)
    policy = SplitPolicy("by_source_file", 42, RESERVED_RATIOS)
    return splits.assign_split(marked, policy, use_reserved=True).select("id", "split")


@query(
    "split_exact",
    oracle(
        """select id, case when r <= floor(n * 0.8::DOUBLE) then 'train'
                           when r <= floor(n * 0.9::DOUBLE) then 'validation' else 'test' end split
           from (select id, row_number() over (order by md5('42:' || id), id) r, count(*) over () n from annotations)""",
        "annotations",
    ),
)
def _(t):
    return splits.assign_split(t.annotations, SplitPolicy("random", 42, RATIOS), exact=True).select("id", "split")


@query(
    "split_exact_reserved",
    oracle(
        """select id, case when reserved then 'test' when r <= floor(n * 0.9::DOUBLE) then 'train' else 'validation' end split
           from (select id, reserved, row_number() over (partition by reserved order by md5('42:' || id), id) r,
                        count(*) over (partition by reserved) n
                 from (select a.id, coalesce(f.test_reserved_at is not null, false) reserved
                       from annotations a left join files f on f.id = a.file_id))""",
        "annotations",
        "files",
    ),
)
def _(t):
    marked = joins.mark_reserved(t.annotations, t.files)
    policy = SplitPolicy("random", 42, RESERVED_RATIOS)
    return splits.assign_split(marked, policy, use_reserved=True, exact=True).select("id", "split")


# ---- paging ---------------------------------------------------------------------------------


@query("page", oracle("select id, file_id, label_key from annotations order by created_at, id limit 20 offset 40", "annotations"))
def _(t):
    return paging.page(t.annotations, 3, 20, ["created_at"]).select("id", "file_id", "label_key")


@query(
    "page_envelope",
    oracle(
        """select cast(i.id as varchar) id, i.name, i.duration_sec, 2 page, 25 page_size, (select count(*) from files) total,
                  (select cast(ceil(count(*) / 25.0) as bigint) from files) total_pages
           from (select id, name, duration_sec from files order by name, id limit 25 offset 25) i""",
        "files",
    ),
)
def _(t):
    files = t.files.select("id", "name", "duration_sec")
    printed = paging.page_envelope(files, "files", 2, 25, ["name"])
    kind = (
        "files array<struct<id:string,name:string,durationSec:double>>, page int, pageSize int, total bigint, totalPages bigint"
    )
    return printed.select(F.from_json("json", kind).alias("p")).select(
        F.inline("p.files").alias("id", "name", "duration_sec"),
        F.col("p.page").alias("page"),
        F.col("p.pageSize").alias("page_size"),
        F.col("p.total").alias("total"),
        F.col("p.totalPages").alias("total_pages"),
    )


@query(
    "number_rows",
    oracle("select id, row_number() over (order by created_at, id) as row_number from annotations", "annotations"),
)
def _(t):
    rows = t.annotations.select("id", "created_at")
    copy = storage.join(storage.scratch_dir(t.spark, "listing"), "rows")
    return paging.number_rows(rows, copy, ["created_at"]).select("id", "row_number")


@query(
    "page_after",
    oracle(
        "select id, name, duration_sec from files where (duration_sec, id) > (5000.0, '77') order by duration_sec, id limit 50",
        "files",
    ),
)
def _(t):
    found = paging.page_after(t.files, {"duration_sec": 5000.0, "id": "77"}, 50, ["duration_sec"])
    return found.select("id", "name", "duration_sec")


_REVIEW_SQL = "select id, review_status, created_at from annotations order by review_status {down} nulls {nulls}, id"


@query("page_after_nulls", oracle(_REVIEW_SQL.format(down="", nulls="first") + " limit 500 offset 300", "annotations"))
def _(t):
    """The page after a row whose order key is null."""
    rows = t.annotations.select("id", "review_status", "created_at")
    last = paging.page(rows, 300, 1, ["review_status"]).first()
    return paging.page_after(rows, last.asDict(), 500, ["review_status"])


@query("page_after_descending", oracle(_REVIEW_SQL.format(down="desc", nulls="last") + " limit 500 offset 300", "annotations"))
def _(t):
    rows = t.annotations.select("id", "review_status", "created_at")
    last = paging.page(rows, 300, 1, ["-review_status"]).first()
    return paging.page_after(rows, last.asDict(), 500, ["-review_status"])


# ---- table changes --------------------------------------------------------------------------

# Ids to reserve: every part key, of which only some are files.
_PART_IDS = "select distinct cast(p_partkey as string) id from part"
_SUPPLIER_IDS = "select distinct cast(s_suppkey as string) id from supplier"


def _part_ids(t):
    return t.raw("part").select(F.col("p_partkey").cast("string").alias("id"))


def _supplier_ids(t):
    return t.raw("supplier").select(F.col("s_suppkey").cast("string").alias("id"))


@query(
    "reserve_files",
    oracle(
        """select id, name, case when id in (select id from ids) then coalesce(test_reserved_at, '2024-03-01T00:00:00Z')
                            else test_reserved_at end test_reserved_at from files""",
        "files",
        ids=_PART_IDS,
    ),
)
def _(t):
    changed, _ = changes.reserve_files(t.files, _part_ids(t), "2024-03-01T00:00:00Z")
    return changed.select("id", "name", "test_reserved_at")


@query(
    "reserve_files_outcomes",
    oracle(
        "select id, case when id in (select id from files) then 'ok' else 'not_found' end status from ids",
        "files",
        ids=_PART_IDS,
    ),
)
def _(t):
    return changes.reserve_files(t.files, _part_ids(t), "2024-03-01T00:00:00Z")[1]


@query(
    "unreserve_files",
    oracle(
        "select id, name, case when id not in (select id from ids) then test_reserved_at end test_reserved_at from files",
        "files",
        ids=_SUPPLIER_IDS,
    ),
)
def _(t):
    return changes.unreserve_files(t.files, _supplier_ids(t))[0].select("id", "name", "test_reserved_at")


@query(
    "soft_delete_exports",
    oracle("select id, status, case when status = 'failed' then '2024-03-01 00:00:00' end deleted_at from exports", "exports"),
)
def _(t):
    doomed = t.exports.where("status = 'failed'").select("id")
    at = F.lit("2024-03-01 00:00:00").cast("timestamp")
    kept = changes.soft_delete_exports(t.exports, doomed, at, confirm=True)
    return kept.select("id", "status", F.date_format("deleted_at", "yyyy-MM-dd HH:mm:ss").alias("deleted_at"))


@query(
    "purge_candidates",
    oracle(
        """select id, status from exports
           where status = 'failed' and created_at <= timestamp '1996-06-10 00:00:00' - interval 7 day""",
        "exports",
    ),
)
def _(t):
    deleted = t.exports.withColumn("deleted_at", F.when(F.col("status") == "failed", F.col("created_at")))
    now = F.lit("1996-06-10 00:00:00").cast("timestamp_ntz")
    return changes.purge_candidates(deleted, now).select("id", "status")
