"""Which runs make up a dataset: small records that name finished run directories.

    runs/whole/<id>/data/split=train/part-*     what a job wrote, never moved afterwards
    runs/batch=7/<id>/data/...                  the same for a batch of a stream
    published/whole/00000001.json               the record that makes a run part of the dataset
    published/batch=7/00000001.json

A run's files lie at their final place from the commit of their tasks on, but nothing reads them before
a record names the run. A record is written under another name and renamed to one that did not exist
(a few hundred bytes, whatever the size of the audio), so it is there whole or not at all; of several in
one folder the last counts. A record holds the run's rows by split, and what they come to with all records
before it: a batch adds its own rows to the sums of the batch before, so its cost does not grow with the
number of batches. A batch that is repeated replaces its record and counts once.

A whole run ends everything before it; batches published after it belong to it (`base`). Files that no
record names any longer are removed after the new record is in place, so a process that dies between any
two steps leaves the old dataset or the new one. There is one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from clipmill import storage

WHOLE = "whole"


@dataclass(frozen=True)
class Record:
    """A published run: where it lies below the dataset (null: a batch without rows), and its rows."""

    run: str | None
    base: str | None = None
    splits: dict[str, int] = field(default_factory=dict)
    quarantined: int = 0
    #: Rows by split of the dataset up to here.
    totals: dict[str, int] = field(default_factory=dict)


def _slot(batch: int | None) -> str:
    return WHOLE if batch is None else f"batch={batch}"


def new_run(batch: int | None = None) -> str:
    """A place for a run below the dataset, used by nothing else."""
    return f"runs/{_slot(batch)}/{uuid.uuid4().hex}"


def _folder(out_dir: str, batch: int | None) -> str:
    return storage.join(out_dir, "published", _slot(batch))


def last_record(spark: SparkSession, out_dir: str, batch: int | None = None) -> Record | None:
    """The record in force of the whole run or of a batch."""
    folder = _folder(out_dir, batch)
    names = [n for n in storage.names(spark, folder) if n.endswith(".json")]
    return Record(**json.loads(storage.read_text(spark, storage.join(folder, max(names))))) if names else None


def records(spark: SparkSession, out_dir: str) -> list[Record]:
    """All records in force: the whole run's first, then the batches that belong to it, by batch.

    Batches are read by a Spark job, since there may be many; the result has a few hundred bytes for each.
    """
    whole = last_record(spark, out_dir)
    base = whole.run if whole else None
    found = [] if whole is None else [whole]
    if any(n.startswith("batch=") for n in storage.names(spark, storage.join(out_dir, "published"))):
        path = F.col("_metadata.file_path")
        texts = spark.read.option("wholetext", "true").text(storage.join(out_dir, "published", "batch=*"))
        batch = F.regexp_extract(path, r"/batch=(\d+)/[^/]*$", 1).cast("long")
        kept = texts.where(path.endswith(".json")).groupBy(batch.alias("batch")).agg(F.max_by("value", path).alias("value"))
        ordered = sorted(kept.collect(), key=lambda r: r.batch)
        found += [r for r in (Record(**json.loads(row.value)) for row in ordered) if r.base == base]
    return found


def _totals_before(spark: SparkSession, out_dir: str, batch: int, whole: Record | None) -> dict[str, int]:
    """Rows of everything but this batch: from the record before, where batches are in order."""
    base = whole.run if whole else None
    later = last_record(spark, out_dir, batch + 1)
    before = last_record(spark, out_dir, batch - 1) if batch else whole
    # Numbers that start anew over an older dataset, or that have gaps: add up all other records.
    if later is not None or (batch and (before is None or before.base != base)):
        own = last_record(spark, out_dir, batch)
        sums: Counter = Counter()
        for record in records(spark, out_dir):
            if own is None or record != own:
                sums.update(record.splits)
        return dict(sums)
    return dict(before.totals) if before else {}


def publish(
    spark: SparkSession, out_dir: str, run: str | None, splits: dict[str, int], quarantined: int = 0, batch: int | None = None
) -> Record:
    """Make a finished run the dataset, or a batch of it, in place of what stood there before."""
    folder = _folder(out_dir, batch)
    splits = {s: n for s, n in splits.items() if n}
    if batch is None:
        record = Record(run, None, splits, quarantined, splits)
    else:
        whole = last_record(spark, out_dir)
        totals = Counter(_totals_before(spark, out_dir, batch, whole)) + Counter(splits)
        record = Record(run, whole.run if whole else None, splits, quarantined, dict(totals))
    used = [int(n.removesuffix(".json")) for n in storage.names(spark, folder) if n.endswith(".json")]
    name = f"{max(used, default=0) + 1:08d}.json"
    storage.write_new(spark, storage.join(folder, name), json.dumps(asdict(record)))
    _clean(spark, out_dir, folder, name, run, batch)
    return record


def discard(spark: SparkSession, out_dir: str, run: str) -> None:
    """Remove a run that failed, with the directories that it leaves empty."""
    storage.remove(spark, storage.join(out_dir, run))
    folder = run.rpartition("/")[0]
    while folder and not storage.names(spark, storage.join(out_dir, folder)):
        storage.remove(spark, storage.join(out_dir, folder))
        folder = folder.rpartition("/")[0]


def _clean(spark: SparkSession, out_dir: str, folder: str, name: str, run: str | None, batch: int | None) -> None:
    """Remove what the new record has replaced, and what broken runs in its place have left."""
    for other in storage.names(spark, folder):
        if other != name:
            storage.remove(spark, storage.join(folder, other))
    own = storage.join(out_dir, "runs", _slot(batch))
    for other in storage.names(spark, own):
        if run is None or other != run.rpartition("/")[2]:
            storage.remove(spark, storage.join(own, other))
    if batch is None:
        for top in ("published", "runs"):
            for slot in storage.names(spark, storage.join(out_dir, top)):
                if slot != WHOLE:
                    storage.remove(spark, storage.join(out_dir, top, slot))
