"""Adapting manifests as they arrive."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from clipmill import publication
from clipmill.operators.validate import validate_manifest
from clipmill.plans.adapt import ADAPTERS, publish_rows
from clipmill.sinks.dataset import write_dataset_card
from clipmill.sources.manifest import checked_records, nonblank_lines, parse_manifest, staged_manifest


def adapt_stream(
    spark: SparkSession,
    manifest_dir: str,
    clips_dir: str,
    out_dir: str,
    checkpoint: str,
    language: str,
    adapter: str = "binary_endpoint",
    how: str = "auto",
    on_error: str = "fail",
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Adapt every manifest file of a directory once, then stop; run again to take in new files.

    The checkpoint remembers the files done. Each micro-batch is validated like a whole manifest and
    published as a batch of the dataset; a bad manifest stops the stream before it writes. A batch that
    is repeated after a failure replaces itself. With ``on_error='quarantine'`` rows whose clip is broken
    are set aside in the batch. The card is written anew after each batch, from the sums that its record
    holds: no file of an earlier batch is opened.
    """

    def handle(lines: DataFrame, batch_id: int) -> None:
        session = lines.sparkSession
        with staged_manifest(session, checked_records(parse_manifest(lines)), lines=lines) as manifest:
            profile = validate_manifest(manifest, allow_empty=True)
            if profile.total == 0:
                record = publication.publish(session, out_dir, None, {}, batch=batch_id)
            else:
                to_dataset = partial(ADAPTERS[adapter], language=language)
                record = publish_rows(session, manifest, profile, clips_dir, out_dir, to_dataset, how, on_error, batch_id)
        runs = ([record.base] if record.base else []) + ["runs/batch=*/*"]
        write_dataset_card(session, out_dir, record.totals, params, runs)

    params = {"manifest": manifest_dir, "clips_dir": clips_dir, "language": language}
    reader = spark.readStream.option("lineSep", "\n")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = nonblank_lines(reader.text(manifest_dir))
    return (
        lines.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
