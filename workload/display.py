"""Queries of the text, JSON and field functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipmill.functions import fields, text
from workload.registry import query
from workload.tables import oracle


@query(
    "label_to_endpoint",
    oracle(
        """select id, label_key, case label_key when 'end_of_turn' then 1 else 0 end endpoint_bool
           from annotations where label_key in ('end_of_turn', 'continuation')""",
        "annotations",
    ),
)
def _(t):
    binary = t.annotations.where(F.col("label_key").isin("end_of_turn", "continuation"))
    return binary.select("id", "label_key", fields.label_to_endpoint(F.col("label_key")).alias("endpoint_bool"))


@query(
    "clip_rel_path",
    """select page_id, path, case when starts_with(path, 'clips/') then substr(path, 7) else path end rel from (
         select page_id, case page_id % 3 when 0 then 'clips/' || url when 1 then 'clips/clips/' || url else url end path
         from pages)""",
)
def _(t):
    kind = F.col("page_id") % 3
    path = (
        F.when(kind == 0, F.concat(F.lit("clips/"), F.col("url")))
        .when(kind == 1, F.concat(F.lit("clips/clips/"), F.col("url")))
        .otherwise(F.col("url"))
    )
    paths = t.raw("pages").select("page_id", path.alias("path"))
    return paths.select("page_id", "path", fields.clip_rel_path(F.col("path")).alias("rel"))


@query(
    "truncate_chars",
    oracle("select id, case when length(asr_text) > 40 then left(asr_text, 39) || '…' else asr_text end short from transcripts", "transcripts"),
)
def _(t):
    return t.transcripts.select("id", text.truncate_chars(F.col("asr_text"), 40).alias("short"))


# No text of the tables holds marks or double-width characters; control characters take no column.
_CONTROL = r"[\x00-\x1f\x7f-\x9f\xad]"
_VISIBLE = r"[^\x00-\x1f\x7f-\x9f\xad]"


def _width_sql(column: str, columns: int) -> str:
    return (
        f"case when length(regexp_replace({column}, '{_CONTROL}', '', 'g')) > {columns} then "
        f"regexp_extract({column}, '^{_CONTROL}*(?:{_VISIBLE}{_CONTROL}*){{0,{columns - 1}}}') || '…' else {column} end"
    )


def _clean_sql(column: str) -> str:
    return rf"nullif(regexp_replace({column}, '^[\s\x{{85}}\x{{a0}}]+|[\s\x{{85}}\x{{a0}}]+$', '', 'g'), '')"


TRANSCRIPT_TEXT_SQL = _width_sql("clean", 80)


@query(
    "truncate_width",
    oracle(f"select id, {TRANSCRIPT_TEXT_SQL} short from (select id, {_clean_sql('asr_text')} clean from transcripts)", "transcripts"),
)
def _(t):
    return t.transcripts.select("id", text.truncate_width(text.clean_text(F.col("asr_text")), 80).alias("short"))


@query(
    "truncate_width_of_turns",
    f"""select conv_id, turn, {_width_sql("text", 24)} short from conversations""",
)
def _(t):
    return t.raw("conversations").select("conv_id", "turn", text.truncate_width(F.col("text"), 24).alias("short"))


_BYTES_SQL = "cast(floor(l_extendedprice * 100) as bigint) * l_linenumber * cast(l_quantity as bigint)"


@query(
    "human_bytes",
    f"""select l_orderkey, l_linenumber, n,
               case when n < 1024 then concat(n, ' B')
                    when n < 1048576 then printf('%.1f KB', n / 1024.0::DOUBLE)
                    when n < 1073741824 then printf('%.1f MB', n / 1048576.0::DOUBLE)
                    else printf('%.1f GB', n / 1073741824.0::DOUBLE) end size_text
        from (select l_orderkey, l_linenumber, {_BYTES_SQL} n from lineitem)""",
)
def _(t):
    n = F.floor(F.col("l_extendedprice") * 100).cast("bigint") * F.col("l_linenumber") * F.col("l_quantity").cast("bigint")
    sized = t.raw("lineitem").select("l_orderkey", "l_linenumber", n.alias("n"))
    return sized.withColumn("size_text", text.human_bytes(F.col("n")))


@query(
    "time_range",
    oracle("select id, printf('%.1f–%.1fs', start_sec, end_sec) range_text, printf('%.1fs', end_sec - start_sec) length_text from annotations", "annotations"),
)
def _(t):
    return t.annotations.select(
        "id",
        text.time_range(F.col("start_sec"), F.col("end_sec")).alias("range_text"),
        text.seconds_text(F.col("end_sec") - F.col("start_sec")).alias("length_text"),
    )


LABEL_TEXT_SQL = "case when length(concat(label_key, '=', label_value)) > 18 then left(concat(label_key, '=', label_value), 17) || '…' else concat(label_key, '=', label_value) end"


@query(
    "label_text",
    "select p_partkey, case when length(concat(p_type, '=', p_size)) > 18 then left(concat(p_type, '=', p_size), 17) || '…' else concat(p_type, '=', p_size) end label_text from part",
)
def _(t):
    return t.raw("part").select("p_partkey", text.label_text(F.col("p_type"), F.col("p_size")).alias("label_text"))


@query(
    "short_id",
    oracle("select id, left(clip_sha256, 8) short, left(file_id, 7) short_file from annotations", "annotations"),
)
def _(t):
    return t.annotations.select(
        "id", text.short_id(F.col("clip_sha256")).alias("short"), text.short_id(F.col("file_id"), 7).alias("short_file")
    )


@query(
    "elapsed_text",
    oracle(
        """select id, concat(cast(floor(duration_sec) as bigint) // 60, ':',
                             lpad(cast(cast(floor(duration_sec) as bigint) % 60 as varchar), 2, '0')) elapsed from files""",
        "files",
    ),
)
def _(t):
    return t.files.select("id", text.elapsed_text(F.col("duration_sec")).alias("elapsed"))


@query(
    "clean_text",
    f"select conv_id, turn, {_clean_sql('padded')} clean from (select conv_id, turn, concat(chr(160), chr(10), text, '  ', chr(9)) padded from conversations)",
)
def _(t):
    padded = F.concat(F.lit(" \n"), F.col("text"), F.lit("  \t"))
    return t.raw("conversations").select("conv_id", "turn", text.clean_text(padded).alias("clean"))


@query(
    "json_text",
    """select event_id, case when json_type(doc, '$.k') = 'VARCHAR' then json_extract_string(doc, '$.k') else '-' end k_text,
              case when json_type(doc, '$.kind') = 'VARCHAR' then json_extract_string(doc, '$.kind') else '-' end kind_text,
              case when json_type(doc, '$.k') in ('UBIGINT', 'BIGINT') then cast(json_extract_string(doc, '$.k') as bigint) end k_long,
              case when json_type(doc, '$.missing') = 'VARCHAR' then '?' else '-' end missing_text
       from (select event_id, concat('{"kind":"', event_type, '",', substr(props, 2)) doc from events)""",
)
def _(t):
    document = F.concat(F.lit('{"kind":"'), F.col("event_type"), F.lit('",'), F.substr("props", F.lit(2)))
    return (
        t.raw("events")
        .select("event_id", document.alias("doc"))
        .select(
            "event_id",
            fields.json_text(F.col("doc"), "$.k").alias("k_text"),
            fields.json_text(F.col("doc"), "$.kind").alias("kind_text"),
            fields.json_long(F.col("doc"), "$.k").alias("k_long"),
            fields.json_text(F.col("doc"), "$.missing").alias("missing_text"),
        )
    )


@query(
    "export_spec_json",
    oracle(
        """select id, concat('{"name":"', name, '",',
                    case when error_message is not null then concat('"description":"', error_message, '",') else '' end,
                    '"filter":{"labelSetId":"', project_id, '-ls","reviewStatuses":["approved"]',
                    case when status = 'failed' then concat(',"labellerIds":[', created_by, ']') else '' end,
                    '},"splitPolicy":{"kind":"random","seed":', created_by, ',"ratios":[0.8,0.1,0.1]}}') spec
           from exports""",
        "exports",
    ),
)
def _(t):
    spec = fields.export_spec_json(
        name=F.col("name"),
        label_set_id=F.concat("project_id", F.lit("-ls")),
        review_statuses=F.array(F.lit("approved")),
        kind=F.lit("random"),
        seed=F.col("created_by"),
        ratios=F.array(F.lit(0.8), F.lit(0.1), F.lit(0.1)),
        description=F.col("error_message"),
        labeller_ids=F.when(F.col("status") == "failed", F.array("created_by")),
    )
    return t.exports.select("id", spec.alias("spec"))


@query("or_dash", oracle("select id, coalesce(error_message, '-') error_text, coalesce(error_message, '—') error_mark from exports", "exports"))
def _(t):
    message = F.col("error_message")
    return t.exports.select("id", text.or_dash(message).alias("error_text"), text.or_dash(message, "—").alias("error_mark"))
