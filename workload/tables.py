"""The given tables in the shape of the catalogue.

Each view is one SELECT that Spark and DuckDB both run; only the JSON field differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SPARK_K = "cast(get_json_object(props, '$.k') as int)"
_DUCKDB_K = "cast(json_extract_string(props, '$.k') as int)"

VIEWS = {
    "files": """
        select cast(c_custkey as string) id, concat('p', cast(c_nationkey as string)) project_id,
               c_name name, abs(c_acctbal) duration_sec,
               case when c_mktsegment = 'BUILDING' then '2024-01-15T00:00:00Z' end test_reserved_at
        from {customer}""",
    "annotations": """
        select cast(event_id as string) id, cast(user_id as string) file_id,
               case event_type when 'purchase' then 'end_of_turn' when 'view' then 'continuation'
                    else event_type end label_key,
               cast(case event_type when 'purchase' then 1 else 0 end as bigint) label_value,
               value start_sec, value + cast({k} as double) / 10 end_sec,
               case {k} % 4 when 0 then 'approved' when 1 then 'rejected' when 2 then 'needs_fix' end review_status,
               event_id % 7 created_by, ts created_at,
               concat('ls', cast(event_id % 4 as string)) label_set_id,
               md5(concat('clip ', cast(event_id as string))) clip_sha256, 16000 clip_sample_rate,
               md5(concat('file ', cast(user_id as string))) source_file_sha256
        from {events}""",
    "transcripts": "select cast(doc_id as string) id, text asr_text from {documents}",
    "projects": """
        select concat('p', cast(n_nationkey as string)) id, n_name name,
               case when n_regionkey <> 4 then concat('ls', cast(n_regionkey as string)) end active_label_set_id,
               concat('2024-01-', lpad(cast(n_nationkey + 1 as string), 2, '0'), 'T00:00:00Z') created_at
        from {nation}""",
    "users": "select s_suppkey id, s_name login from {supplier}",
    "exports": """
        select cast(o_orderkey as string) id, concat('p', cast(o_custkey % 25 as string)) project_id,
               concat('export ', cast(o_orderkey as string)) name,
               case o_orderstatus when 'F' then 'ready' when 'O' then 'pending' else 'failed' end status,
               o_custkey % 1500 created_by, o_orderdate created_at,
               case when o_orderstatus = 'P' then concat('priority ', o_orderpriority) end error_message,
               case o_orderkey % 3 when 0 then concat('  asked for as ', o_orderpriority, ' ') when 1 then '   ' end description
        from {orders}""",
    "export_clips": """
        select cast(l_orderkey as string) export_id, cast(l_quantity * 1000 as bigint) length from {lineitem}""",
    "waveforms": """
        select vec_id clip_id, embedding samples, cast(1 + label % 2 as int) channels,
               case vec_id % 4 when 0 then 8000 when 1 then 16000 when 2 then 44100 else 48000 end sample_rate
        from {embeddings}""",
    "clip_manifest": """
        select cast(vec_id as string) annotation_id, concat('clips/', cast(vec_id as string), '.wav') clip_path,
               md5(concat('clip ', cast(vec_id as string))) clip_sha256,
               cast(vec_id as double) / 8 clip_duration_sec, 16000 clip_sample_rate,
               case label % 2 when 1 then 'end_of_turn' else 'continuation' end label_key,
               cast(label % 2 as bigint) label_value,
               concat('f', cast(label as string)) source_file_id,
               md5(concat('file ', cast(label as string))) source_file_sha256,
               cast(label % 7 as bigint) labeller_id,
               case label % 3 when 0 then 'approved' end review_status,
               case label % 5 when 0 then 'test' when 1 then 'validation' else 'train' end split
        from {embeddings}""",
}


def _source(view: str) -> str:
    text = VIEWS[view]
    return text[text.index("from {") + 6 :].split("}")[0]


class Tables:
    """Views and raw tables of one data directory, as attributes: ``t.files``, ``t.raw("events")``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        table = _source(name)
        return self.spark.sql(VIEWS[name].replace("{k}", _SPARK_K), **{table: self.raw(table)})


def oracle(body: str, *names: str, **ctes: str) -> str:
    """DuckDB SQL: the views named, further named subqueries, then the query itself."""
    parts = {}
    for name in names:
        table = _source(name)
        parts[name] = VIEWS[name].replace("{k}", _DUCKDB_K).replace("{" + table + "}", table)
    parts |= ctes
    head = ",\n".join(f"{name} as ({text})" for name, text in parts.items())
    return f"with {head}\n{body}" if parts else body
