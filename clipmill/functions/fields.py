"""Manifest and JSON field expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipmill.functions.once import once
from clipmill.schemas import BINARY_LABELS


def label_to_endpoint(label_key: Column) -> Column:
    """1 for ``end_of_turn``, 0 for ``continuation``; any other label fails the job."""
    refusal = F.raise_error(
        F.concat(
            F.lit("label_key '"),
            F.coalesce(label_key, F.lit("null")),
            F.lit(f"' is not one of the binary labels {', '.join(BINARY_LABELS)}"),
        )
    )
    chosen = None
    for label, value in BINARY_LABELS.items():
        case = (label_key == label, F.lit(value))
        chosen = F.when(*case) if chosen is None else chosen.when(*case)
    return chosen.otherwise(refusal.cast("int")).cast("int")


def clip_rel_path(clip_path: Column) -> Column:
    """Path below the clips directory: one leading ``clips/`` is dropped."""
    prefix = "clips/"
    return F.when(
        F.startswith(clip_path, F.lit(prefix)), F.substr(clip_path, F.lit(len(prefix) + 1))
    ).otherwise(clip_path)


def _json_field(document: Column, path: str, variant_type: str, sql_type: str) -> Column:
    """The field if its JSON kind is the one asked for, else null; the text is parsed once."""

    def pick(parsed: Column) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
        return F.when(kind == variant_type, F.try_variant_get(parsed, path, sql_type))

    return once(F.try_parse_json(document), pick)


def json_texts(document: Column, defaults: dict[str, str | None]) -> Column:
    """String fields of a JSON text as one struct, which parses the text once for all of them.

    ``defaults`` maps a top-level field to what stands for a missing, null or non-string value.
    """

    def pick(parsed: Column) -> Column:
        fields = []
        for name, default in defaults.items():
            path = f"$.{name}"
            kind = F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
            text = F.when(kind == "STRING", F.try_variant_get(parsed, path, "string"))
            fields.append((text if default is None else F.coalesce(text, F.lit(default))).alias(name))
        return F.struct(*fields)

    return once(F.try_parse_json(document), pick)


def json_text(document: Column, path: str, default: str | None = "-") -> Column:
    """A string field of a JSON text; missing, null and non-string values give the default."""
    text = _json_field(document, path, "STRING", "string")
    return text if default is None else F.coalesce(text, F.lit(default))


def json_long(document: Column, path: str) -> Column:
    """An integer field of a JSON text, else null."""
    return _json_field(document, path, "BIGINT", "bigint")


def export_spec_json(
    name: Column,
    label_set_id: Column,
    review_statuses: Column,
    kind: Column,
    seed: Column,
    ratios: Column,
    description: Column | None = None,
    label_keys: Column | None = None,
    labeller_ids: Column | None = None,
    created_at_from: Column | None = None,
    created_at_to: Column | None = None,
    use_reserved_test_files: Column | None = None,
) -> Column:
    """The request body of an export per row; null fields are left out of the JSON."""

    def pick(**columns: Column | None) -> list[Column]:
        return [c.alias(key) for key, c in columns.items() if c is not None]

    chosen = F.struct(
        *pick(
            labelSetId=label_set_id,
            reviewStatuses=review_statuses,
            labelKeys=label_keys,
            labellerIds=labeller_ids,
            createdAtFrom=created_at_from,
            createdAtTo=created_at_to,
            useReservedTestFiles=use_reserved_test_files,
        )
    )
    policy = F.struct(
        kind.alias("kind"), seed.cast("bigint").alias("seed"), ratios.cast("array<double>").alias("ratios")
    )
    body = pick(name=name, description=description, filter=chosen, splitPolicy=policy)
    return F.to_json(F.struct(*body))
