"""Queries that run the composed jobs on files written from the given tables."""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipmill import ExportSpec, SplitPolicy, storage
from clipmill.functions.fields import clip_rel_path
from clipmill.operators.validate import validate_manifest
from clipmill.plans import adapt as adapt_plan
from clipmill.operators.paging import page_envelope
from clipmill.plans.freeze import freeze_export, save_export
from clipmill.plans.materialize import materialize, write_clips
from clipmill.schemas import EXPORTS, MANIFEST, wire_name, wire_schema
from clipmill.sinks.dataset import META_FILE
from clipmill.sinks.manifest import manifest_line, write_manifest
from clipmill.sources.clips import attach_clips, list_clips, read_clips
from clipmill.sources.dataset import read_dataset
from clipmill.sources.export_dir import Export, open_export
from clipmill.sources.manifest import bad_lines, read_manifest
from clipmill.sources.pages import read_pages
from clipmill.streaming.adapt_stream import adapt_stream
from workload.audio import _DECODED, WAV_INPUTS, named_waveforms, pcm_of, pcm_oracle, wav_maker
from workload.catalogue import FINGERPRINT_SQL, HASHED_SQL, MANIFEST_SQL, RESERVED_RATIOS, manifest, uniform_sql
from workload.registry import query
from workload.tables import Tables, oracle

MANIFEST_NAMES = ", ".join(MANIFEST.fieldNames())


def store_clips(wavs: DataFrame, clips_dir: str, **made) -> int:
    """Write clips as files and wait for them; returns how many."""
    storage.make_dirs(wavs.sparkSession, clips_dir)
    files = wavs.withColumn("rel", clip_rel_path(F.col("clip_path")))
    return write_clips(files, clips_dir, **made).agg(F.count("written")).head()[0]


def store_waveforms(waveforms: DataFrame, clips_dir: str) -> int:
    """The same for waveforms, whose WAV files are made by the workers that write them."""
    return store_clips(waveforms, clips_dir, make=wav_maker(), inputs=WAV_INPUTS)


def counts_table(t: Tables, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of counts as a table; as Arrow data they need no Python workers, unlike a list of tuples."""
    columns = [pa.array(column, pa.int64()) for column in zip(*rows)]
    return t.spark.createDataFrame(pa.table(columns, T.StructType.fromDDL(schema).names), schema)


# Exports written by this process, by application and data directory. Jobs only read them.
_EXPORTS: dict[tuple[str, str], Export] = {}


def export_on_disk(t: Tables) -> Export:
    """Manifest and WAV files of all waveforms, in a shared directory."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _EXPORTS:
        root = storage.scratch_dir(t.spark, "export")
        store_waveforms(named_waveforms(t), storage.join(root, "clips"))
        write_manifest(t.clip_manifest, root)
        _EXPORTS[key] = open_export(t.spark, root)
    return _EXPORTS[key]


# ---- sources and sinks ------------------------------------------------------------------------


@query("manifest_round_trip", oracle(f"select {MANIFEST_NAMES} from manifest", "annotations", manifest=MANIFEST_SQL))
def _(t):
    path = write_manifest(manifest(t), storage.scratch_dir(t.spark, "manifest"))
    return read_manifest(t.spark, path)


@query(
    "bad_manifest_lines",
    oracle(
        """select annotation_id, place, 'not valid JSON' problem from (
             select annotation_id, cast(row_number() over (order by annotation_id) as bigint) place from manifest)
           where annotation_id like '%7'""",
        "annotations",
        manifest=MANIFEST_SQL,
    ),
)
def _(t):
    # Files in the order of the ids, some lines spoilt; a line's place adds the lines of the files before.
    rows = manifest(t)
    spoilt = F.when(F.endswith("annotation_id", F.lit("7")), "#").otherwise("")
    path = storage.join(storage.scratch_dir(t.spark, "manifest"), "lines")
    rows.orderBy("annotation_id").select(F.concat(spoilt, manifest_line(rows)).alias("value")).write.text(path)
    files = t.spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    offsets = files.select("file", F.coalesce(before, F.lit(0)).alias("before"))
    found = bad_lines(t.spark, path).join(offsets, "file")
    name = F.get_json_object(F.substr("line", F.lit(2)), "$.annotationId").alias("annotation_id")
    return found.select(name, (F.col("before") + F.col("number")).alias("place"), "problem")


_CLIPS_SQL = oracle(
    """select concat(clip_id, '.wav') rel,
              cast(44 + 64 * case clip_id % 5 when 0 then 1 when 1 then 2 when 2 then 3 else 4 end as bigint) length from waveforms""",
    "waveforms",
)


@query("read_clips", _CLIPS_SQL)
def _(t):
    export = export_on_disk(t)
    return read_clips(t.spark, export.clips_dir).select("rel", "length")


@query("list_clips", _CLIPS_SQL)
def _(t):
    export = export_on_disk(t)
    return list_clips(t.spark, export.clips_dir, storage.scratch_dir(t.spark, "listing"))


_FILES_PER_PAGE = 100


@query(
    "read_pages",
    oracle(
        """select f.id, f.name, f.duration_sec, f.test_reserved_at, coalesce(n, 0) annotation_count from files f
           left join (select file_id, count(*) n from annotations group by 1) a on a.file_id = f.id""",
        "files",
        "annotations",
    ),
)
def _(t):
    # Saved pages as a listing prints them: one envelope per page; the count is left out when 0.
    counts = t.annotations.groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("annotationCount"))
    item = F.struct(
        "id",
        "name",
        F.col("duration_sec").alias("durationSec"),
        F.col("test_reserved_at").alias("testReservedAt"),
        "annotationCount",
    )
    number = F.floor(F.col("id").cast("bigint") / _FILES_PER_PAGE).cast("int")
    pages = t.files.join(counts, "id", "left").groupBy(number.alias("page")).agg(F.collect_list(item).alias("files"))
    folder = storage.join(storage.scratch_dir(t.spark, "pages"), "files")
    envelope = F.to_json(F.struct("files", "page", F.lit(_FILES_PER_PAGE).alias("pageSize")))
    pages.select(envelope.alias("value")).write.text(folder)
    return read_pages(t.spark, folder, "files")


# ---- freeze -------------------------------------------------------------------------------------

SPEC = ExportSpec(
    "p3",
    "frozen",
    label_set_id="ls1",
    review_statuses=("approved", "unreviewed"),
    use_reserved_test_files=True,
    split=SplitPolicy("by_source_file", 42, RESERVED_RATIOS),
)

_FROZEN_ROWS = f"""
    select a.id annotation_id, concat('clips/', a.id, '.wav') clip_path, a.clip_sha256,
           end_sec - start_sec clip_duration_sec, a.clip_sample_rate, label_key, label_value, file_id source_file_id,
           a.source_file_sha256, created_by labeller_id, review_status,
           case when f.test_reserved_at is not null then 'test'
                when {uniform_sql("a.file_id")} < {RESERVED_RATIOS[0]!r} then 'train' else 'validation' end split
    from annotations a join files f on f.id = a.file_id
    where f.project_id = 'p3' and label_set_id = 'ls1'
      and (review_status in ('approved', 'unreviewed') or review_status is null)"""


def _clip_sizes(t: Tables) -> DataFrame:
    return t.annotations.select(F.col("id").alias("annotation_id"), F.length("label_key").cast("bigint").alias("length"))


def _freeze(t: Tables):
    files, sizes = t.files, _clip_sizes(t)
    return freeze_export(t.annotations, files, t.projects, SPEC, "e1", 1, "2024-03-01T00:00:00Z", clips=sizes)


@query("freeze_manifest", oracle(_FROZEN_ROWS, "annotations", "files"))
def _(t):
    return _freeze(t).manifest.select(MANIFEST.fieldNames())


_EXPORT_ROW = f"""
    select 'e1' id, 'p3' project_id, 'frozen' name, 'ready' status, count(*) clip_count,
           cast(sum(length(label_key)) as bigint) total_bytes, 1::BIGINT created_by, {FINGERPRINT_SQL} manifest_sha256"""


@query(
    "freeze_export",
    oracle(
        f"""{_EXPORT_ROW},
             '{{"labelSetId":"ls1","reviewStatuses":["approved","unreviewed"],"useReservedTestFiles":true}}' "filter",
             '{{"kind":"by_source_file","seed":42,"ratios":[0.9,0.1,0.0]}}' split_policy
           from (select *, {HASHED_SQL} h from frozen)""",
        "annotations",
        "files",
        frozen=_FROZEN_ROWS,
    ),
)
def _(t):
    names = "id project_id name status clip_count total_bytes created_by manifest_sha256 filter split_policy".split()
    return _freeze(t).export.select(*names)


@query(
    "freeze_export_page",
    oracle(
        f"""{_EXPORT_ROW}, 'exports/e1' r2_prefix, '2024-03-01T00:00:00Z' ready_at, true can_download, true can_delete,
             '{{"id":"ls1"}}' label_set_snapshot
           from (select *, {HASHED_SQL} h from frozen)""",
        "annotations",
        "files",
        frozen=_FROZEN_ROWS,
    ),
)
def _(t):
    """The record printed as a page of exports and read back."""
    path = storage.join(storage.scratch_dir(t.spark, "pages"), "exports")
    page_envelope(_freeze(t).export, "exports").write.text(path)
    names = "id project_id name status clip_count total_bytes created_by manifest_sha256".split()
    return read_pages(t.spark, path, "exports").select(
        *names, "r2_prefix", "ready_at", "can_download", "can_delete", "label_set_snapshot"
    )


def _save(t: Tables):
    out = storage.scratch_dir(t.spark, "saved")
    sizes = _clip_sizes(t)
    record = save_export(t.annotations, t.files, t.projects, SPEC, "e1", out, 1, "2024-03-01T00:00:00Z", clips=sizes)
    return out, record


@query("save_export_manifest", oracle(_FROZEN_ROWS, "annotations", "files"))
def _(t):
    return read_manifest(t.spark, storage.join(_save(t)[0], "manifest.jsonl"))


@query(
    "save_export_record",
    oracle(f"{_EXPORT_ROW} from (select *, {HASHED_SQL} h from frozen)", "annotations", "files", frozen=_FROZEN_ROWS),
)
def _(t):
    names = "id project_id name status clip_count total_bytes created_by manifest_sha256".split()
    wire = T.StructType([f for f in wire_schema(EXPORTS) if f.name in map(wire_name, names)])
    saved = t.spark.read.schema(wire).json(storage.join(_save(t)[0], "export.json"), multiLine=True)
    return saved.select(*[F.col(wire_name(n)).alias(n) for n in names])


@query(
    "freeze_reserved_files",
    oracle("select id file_id, 'e1' export_id from files where project_id = 'p3' and test_reserved_at is not null", "files"),
)
def _(t):
    return _freeze(t).reserved_files


# ---- materialize --------------------------------------------------------------------------------


@query(
    "materialize",
    oracle(
        """select count(*) total, count(*) filter (where label_value = 1) skipped,
                  count(*) filter (where label_value = 0) downloaded,
                  cast(sum(44 + 64 * case cast(annotation_id as bigint) % 5 when 0 then 1 when 1 then 2 when 2 then 3 else 4 end)
                       filter (where label_value = 0) as bigint) bytes
           from clip_manifest""",
        "clip_manifest",
    ),
)
def _(t):
    source = export_on_disk(t)
    out = storage.scratch_dir(t.spark, "materialized")
    # An earlier run got as far as the clips of one label.
    done = t.clip_manifest.where("label_value = 1").select("clip_path")
    store_waveforms(named_waveforms(t).join(done, "clip_path", "left_semi"), storage.join(out, "clips"))
    exports = t.exports.where("status = 'ready'")
    chosen = exports.agg(F.min("id")).head()[0]
    result = materialize(t.spark, exports, chosen, source.manifest(), source.clips_dir, out)
    row = (result.total, result.skipped, result.downloaded, result.bytes)
    return counts_table(t, [row], "total bigint, skipped bigint, downloaded bigint, bytes bigint")


@query(
    "materialize_again",
    oracle(
        """select run, count(*) total, count(*) filter (where run = 3 or run = 2 and label_value = 1) skipped,
                  count(*) filter (where run = 1 or run = 2 and label_value = 0) downloaded
           from clip_manifest, (values (1), (2), (3)) r(run) group by run""",
        "clip_manifest",
    ),
)
def _(t):
    # All clips are brought; then those of one label are gone and have new digests, the others are known;
    # then all are known.
    source = export_on_disk(t)
    out = storage.scratch_dir(t.spark, "materialized")
    exports = t.exports.where("status = 'ready'")
    chosen = exports.agg(F.min("id")).head()[0]
    manifest = source.manifest()
    digest = F.when(F.col("label_value") == 0, F.concat(F.lit("new"), "clip_sha256")).otherwise(F.col("clip_sha256"))
    changed = manifest.withColumn("clip_sha256", digest)
    rows = []
    for run, wanted in enumerate([manifest, changed, changed], 1):
        if run == 2:
            storage.remove(t.spark, storage.join(out, "clips"))
            done = t.clip_manifest.where("label_value = 1").select("clip_path")
            store_waveforms(named_waveforms(t).join(done, "clip_path", "left_semi"), storage.join(out, "clips"))
        result = materialize(t.spark, exports, chosen, wanted, source.clips_dir, out)
        rows.append((run, result.total, result.skipped, result.downloaded))
    return counts_table(t, rows, "run int, total bigint, skipped bigint, downloaded bigint")


# ---- adapt --------------------------------------------------------------------------------------

_DATASET_SQL = pcm_oracle(
    """select m.annotation_id, m.clip_path audio_path, case m.label_key when 'end_of_turn' then 1 else 0 end endpoint_bool,
              'en' "language", m.clip_sha256, m.source_file_id, m.source_file_sha256, m.labeller_id, m.clip_duration_sec,
              m.split, len(p.pcm) n_samples, array_to_string(p.pcm, ',') pcm
       from clip_manifest m join pcm_clips p on cast(p.clip_id as varchar) = m.annotation_id""",
    "decoded",
    "clip_manifest",
    decoded=_DECODED,
)


def dataset_rows(dataset: DataFrame) -> DataFrame:
    flat = dataset.withColumn("bytes", F.col("audio.bytes")).withColumn("audio_path", F.col("audio.path")).drop("audio")
    return pcm_of(flat).drop("channels", "sample_rate", "bits", "format", "samples", "error")


@query(
    "dataset_card",
    oracle("""select split, count(*) n, 'en' "language" from clip_manifest group by split""", "clip_manifest"),
)
def _(t):
    out = storage.scratch_dir(t.spark, "dataset")
    adapt_plan.adapt_binary_endpoint(t.spark, export_on_disk(t), out, "en")
    meta = t.spark.read.json(storage.join(out, META_FILE), "split_counts map<string,bigint>, language string", multiLine=True)
    return meta.select(F.explode("split_counts").alias("split", "n"), "language")


_BYTES_SQL = "44 + 64 * case cast(annotation_id as bigint) % 5 when 0 then 1 when 1 then 2 when 2 then 3 else 4 end"

for _how in ("scan", "by_path"):

    @query(
        f"attach_clips_{_how}",
        oracle(f"select annotation_id, clip_path, split, {_BYTES_SQL} clip_bytes from clip_manifest", "clip_manifest"),
    )
    def _(t, how=_how):
        export = export_on_disk(t)
        manifest = export.manifest()
        rows = attach_clips(t.spark, manifest, export.clips_dir, validate_manifest(manifest), how)
        return rows.select("annotation_id", "clip_path", "split", F.octet_length("content").alias("clip_bytes"))

    @query(f"adapt_binary_endpoint_{_how}", _DATASET_SQL)
    def _(t, how=_how):
        out = storage.scratch_dir(t.spark, "dataset")
        adapt_plan.adapt_binary_endpoint(t.spark, export_on_disk(t), out, "en", how=how)
        return dataset_rows(read_dataset(t.spark, out))


@query(
    "dataset_republished",
    oracle(
        """select annotation_id, split, count(*) n from (
             select * from clip_manifest union all select * from clip_manifest where label_value = 0) group by all""",
        "clip_manifest",
    ),
)
def _(t):
    # A whole run, then a batch that is repeated with other rows: the last record of each counts.
    export, out = export_on_disk(t), storage.scratch_dir(t.spark, "dataset")
    adapt_plan.adapt_binary_endpoint(t.spark, export, out, "en")
    for label in (1, 0):
        rows = export.manifest().where(F.col("label_value") == label)
        to_dataset = partial(adapt_plan.binary_endpoint, language="en")
        adapt_plan.publish_rows(t.spark, rows, validate_manifest(rows), export.clips_dir, out, to_dataset, batch=0)
    return read_dataset(t.spark, out).groupBy("annotation_id", "split").agg(F.count("*").alias("n"))


@query("adapt_stream", _DATASET_SQL)
def _(t):
    export = export_on_disk(t)
    root = storage.scratch_dir(t.spark, "stream")
    incoming, out = storage.join(root, "incoming"), storage.join(root, "dataset")
    storage.make_dirs(t.spark, incoming)
    # Manifests arrive in two deliveries; the last run finds nothing new.
    for label in ("end_of_turn", "continuation", None):
        if label is not None:
            write_manifest(t.clip_manifest.where(F.col("label_key") == label), root, label)
            _deliver(t, storage.join(root, label), incoming, label)
        run = adapt_stream(t.spark, incoming, export.clips_dir, out, storage.join(root, "checkpoint"), "en")
        run.awaitTermination()
    return dataset_rows(read_dataset(t.spark, out))


def _deliver(t: Tables, folder: str, incoming: str, label: str) -> None:
    """Move the finished line files of a folder into the watched directory."""
    names = t.spark.read.text(folder).select("_metadata.file_name").distinct().collect()  # one per written part
    for i, row in enumerate(names):
        storage.rename(t.spark, storage.join(folder, row.file_name), storage.join(incoming, f"{label}-{i}.jsonl"))
