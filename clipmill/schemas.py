"""Record schemas and the fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the record formats.
SPLITS = ("train", "validation", "test")
BINARY_LABELS = {"end_of_turn": 1, "continuation": 0}
SPLIT_KINDS = ("random", "by_source_file", "by_labeller")
TARGET_RATE = 16_000
DEFAULT_SEED = 42
DEFAULT_PAGE_SIZE = 20


def _field(name: str, kind: T.DataType, required: bool = True) -> T.StructField:
    return T.StructField(name, kind, nullable=not required)


MANIFEST = T.StructType(
    [
        _field("annotation_id", T.StringType()),
        _field("clip_path", T.StringType()),
        _field("clip_sha256", T.StringType()),
        _field("clip_duration_sec", T.DoubleType()),
        _field("clip_sample_rate", T.IntegerType()),
        _field("label_key", T.StringType()),
        _field("label_value", T.LongType()),
        _field("source_file_id", T.StringType()),
        _field("source_file_sha256", T.StringType()),
        _field("labeller_id", T.LongType()),
        _field("review_status", T.StringType(), required=False),
        _field("split", T.StringType()),
    ]
)

# Present in manifest lines, not part of the record.
MANIFEST_EXTRAS = ("start_sec", "end_sec", "pad_sec")

AUDIO = T.StructType(
    [_field("bytes", T.BinaryType(), False), _field("path", T.StringType(), False)]
)

DATASET = T.StructType(
    [
        _field("annotation_id", T.StringType()),
        _field("audio", AUDIO),
        _field("endpoint_bool", T.IntegerType()),
        _field("language", T.StringType()),
        _field("clip_sha256", T.StringType()),
        _field("source_file_id", T.StringType()),
        _field("source_file_sha256", T.StringType()),
        _field("labeller_id", T.LongType()),
        _field("clip_duration_sec", T.DoubleType()),
    ]
)

#: What the dataset's fields hold, for readers of its card.
DATASET_FIELDS = {
    "annotation_id": "the labelled stretch this clip was cut for",
    "audio": f"the sound as a {TARGET_RATE} Hz one-channel WAV, with its place in the export",
    "endpoint_bool": ", ".join(f"{value} if labelled {label}" for label, value in BINARY_LABELS.items()),
    "language": "the tag given when the dataset was made",
    "clip_sha256": "digest of the clip before conversion",
    "source_file_id": "the recording the clip comes from; keep one recording in one split",
    "source_file_sha256": "digest of that recording",
    "labeller_id": "who labelled it",
    "clip_duration_sec": "length before conversion, in seconds",
}

ANNOTATIONS = T.StructType(
    [
        _field("id", T.StringType()),
        _field("file_name", T.StringType(), False),
        _field("label_key", T.StringType()),
        _field("label_value", T.LongType()),
        _field("start_sec", T.DoubleType()),
        _field("end_sec", T.DoubleType()),
        _field("review_status", T.StringType(), False),
        _field("asr_text", T.StringType(), False),
    ]
)

FILES = T.StructType(
    [
        _field("id", T.StringType()),
        _field("name", T.StringType()),
        _field("duration_sec", T.DoubleType()),
        _field("test_reserved_at", T.StringType(), False),
        _field("annotation_count", T.LongType()),
    ]
)

PROJECTS = T.StructType(
    [
        _field("id", T.StringType()),
        _field("name", T.StringType()),
        _field("created_at", T.StringType()),
    ]
)

EXPORTS = T.StructType(
    [
        _field("id", T.StringType()),
        _field("project_id", T.StringType()),
        _field("name", T.StringType()),
        _field("description", T.StringType(), False),
        _field("status", T.StringType()),
        _field("filter", T.StringType(), False),
        _field("split_policy", T.StringType(), False),
        _field("label_set_snapshot", T.StringType(), False),
        _field("r2_prefix", T.StringType()),
        _field("manifest_sha256", T.StringType(), False),
        _field("clip_count", T.LongType(), False),
        _field("total_bytes", T.LongType(), False),
        _field("created_by", T.LongType()),
        _field("created_by_login", T.StringType(), False),
        _field("created_at", T.StringType()),
        _field("ready_at", T.StringType(), False),
        _field("error_message", T.StringType(), False),
        _field("can_download", T.BooleanType()),
        _field("can_delete", T.BooleanType()),
    ]
)

# Fields that are 0 or false when a catalogue page leaves them out.
PAGE_DEFAULTS = {"annotation_count": 0, "can_download": False, "can_delete": False}

PAGE_ITEMS = {
    "annotations": ANNOTATIONS,
    "files": FILES,
    "projects": PROJECTS,
    "exports": EXPORTS,
}


def wire_name(column: str) -> str:
    """snake_case column name to the camelCase name used in JSON."""
    head, *rest = column.split("_")
    return head + "".join(word.capitalize() for word in rest)


def required_fields(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if not f.nullable]


def wire_schema(schema: T.StructType) -> T.StructType:
    """The same record with camelCase names and every field nullable, for JSON readers."""
    return T.StructType([T.StructField(wire_name(f.name), f.dataType, True) for f in schema.fields])
