"""Clip bytes as table steps: one Arrow pass per step, samples never become rows."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipmill import files_io, storage
from clipmill.functions import wav
from clipmill.shipping import ship

# Output batches are cut at this many payload bytes, whatever the size of the input batch.
# Small ones stay in the processor's cache on their way to Spark, which works on one while the next is made.
BATCH_BYTES = 4 << 20

# Files a task reads in front of the one it works on, to cover the latency of the storage.
READS_AHEAD = 8

DECODED = T.StructType(
    [
        T.StructField("channels", T.IntegerType()),
        T.StructField("sample_rate", T.IntegerType()),
        T.StructField("bits", T.IntegerType()),
        T.StructField("format", T.StringType()),
        T.StructField("samples", T.ArrayType(T.FloatType())),
        T.StructField("error", T.StringType()),
    ]
)


# Arrow types of the columns that conversions make.
_ARROW = {
    T.IntegerType(): pa.int32(),
    T.LongType(): pa.int64(),
    T.StringType(): pa.string(),
    T.BinaryType(): pa.binary(),
    T.ArrayType(T.FloatType()): pa.list_(pa.float32()),
}


def _read_ahead(pool: ThreadPoolExecutor, read: Callable, rows: Iterator[dict]) -> Iterator[tuple]:
    """Each row with the future of its read, a few reads in front of the row being used."""
    waiting = deque()
    for row in rows:
        waiting.append((row, pool.submit(read, row)))
        if len(waiting) >= READS_AHEAD:
            yield waiting.popleft()
    yield from waiting


def map_rows(
    df: DataFrame,
    convert: Callable[..., tuple[dict, int]],
    inputs: tuple[str, ...],
    made: T.StructType,
    drop: tuple[str, ...] = (),
    read: Callable[[dict], object] | None = None,
) -> DataFrame:
    """Add the ``made`` columns by running ``convert`` on each row inside ``mapInArrow``.

    ``convert`` sees the ``inputs`` columns of a row as Arrow scalars and returns the new values
    with their size in bytes. All columns but ``drop`` pass through as the Arrow arrays they are.
    With ``read``, storage is read ahead in threads and ``convert`` gets the future as well.
    """
    names = made.fieldNames()
    passed = [f for f in df.schema.fields if f.name not in (*drop, *names)]
    kept = [f.name for f in passed]
    types = [_ARROW[f.dataType] for f in made.fields]

    def rebatch(batch: pa.RecordBatch, start: int, stop: int, rows: list[dict]) -> pa.RecordBatch:
        arrays = [batch.column(n).slice(start, stop - start) for n in kept]
        arrays += [pa.array([r[n] for r in rows], type=t) for n, t in zip(names, types)]
        return pa.RecordBatch.from_arrays(arrays, names=[*kept, *names])

    def scalars(batch: pa.RecordBatch) -> Iterator[dict]:
        columns = {n: batch.column(n) for n in inputs}
        return ({n: column[i] for n, column in columns.items()} for i in range(batch.num_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(READS_AHEAD) as pool:  # starts no thread until it is used
            for batch in batches:
                rows = scalars(batch)
                calls = _read_ahead(pool, read, rows) if read else ((row,) for row in rows)
                start, size, done = 0, 0, []
                for i, call in enumerate(calls):
                    values, weight = convert(*call)
                    done.append(values)
                    size += weight
                    if size >= BATCH_BYTES:
                        yield rebatch(batch, start, i + 1, done)
                        start, size, done = i + 1, 0, []
                if done:
                    yield rebatch(batch, start, batch.num_rows, done)

    ship(df.sparkSession)
    return df.mapInArrow(run, T.StructType([*passed, *made.fields]))


def decode_clips(df: DataFrame, content: str = "content") -> DataFrame:
    """Replace clip bytes by channels, rate, bits, format and interleaved float samples.

    Clips that cannot be decoded have a null for each of these and the reason in ``error``.
    """

    def convert(row):
        payload = row[content]
        try:
            info = wav.parse(payload.as_buffer() if payload.is_valid else b"")
            samples = wav.decode(info)
        except wav.WavError as bad:
            return dict.fromkeys(DECODED.fieldNames()) | {"error": str(bad)}, 64
        kind = "float" if info.format == wav.FORMAT_FLOAT else "int"
        values = {"channels": info.channels, "sample_rate": info.rate, "bits": info.bits, "format": kind}
        return values | {"samples": samples, "error": None}, samples.nbytes

    return map_rows(df, convert, (content,), DECODED, drop=(content,))


_CANONICAL = T.StructType([T.StructField("bytes", T.BinaryType()), T.StructField("error", T.StringType())])


def _canonical_row(raw, path: str) -> tuple[dict, int]:
    try:
        data = wav.canonicalize(raw)
    except wav.WavError as bad:
        return {"bytes": None, "error": f"canonicalising clip {path}: {bad}"}, 64
    return {"bytes": data, "error": None}, len(data)


def try_canonicalize_clips(df: DataFrame, content: str = "content", path: str = "clip_path") -> DataFrame:
    """Replace clip bytes by canonical ``bytes`` or, where that fails, by an ``error`` naming the path."""

    def convert(row):
        payload = row[content]
        return _canonical_row(payload.as_buffer() if payload.is_valid else b"", row[path].as_py())

    return map_rows(df, convert, (content, path), _CANONICAL, drop=(content,))


def try_canonicalize_files(
    df: DataFrame, clips_dir: str, rel: str = "rel", path: str = "clip_path"
) -> DataFrame:
    """The same for files named by ``rel``: each task opens its own, so raw bytes stay in the worker.

    A file that cannot be read fails the task, for Spark to try again. A task keeps as many buffers
    as it reads files ahead; a converted clip leaves its buffer to a later one.
    """
    root = storage.qualify(df.sparkSession, clips_dir)
    spare: deque[bytearray] = deque()

    def read(row):
        try:
            buffer = spare.pop()
        except IndexError:
            buffer = bytearray()
        return files_io.read_into(root, row[rel].as_py(), buffer)

    def convert(row, raw):
        name = row[path].as_py()
        try:
            buffer, data = raw.result()
        except OSError as bad:
            raise OSError(f"reading clip {name}: {bad}") from bad
        made = _canonical_row(data, name)
        spare.append(buffer)
        return made

    return map_rows(df, convert, (rel, path), _CANONICAL, drop=(rel,), read=read)


def settle_errors(df: DataFrame, on_error: str = "fail") -> DataFrame:
    """Turn rows with an ``error`` into a failure of the job, or leave them for a side table."""
    if on_error == "quarantine":
        return df
    if on_error != "fail":
        raise ValueError(f"on_error is 'fail' or 'quarantine', not {on_error!r}")
    fine = F.when(F.col("error").isNull(), F.lit(True)).otherwise(F.raise_error(F.col("error")).cast("boolean"))
    return df.where(fine).drop("error")


def canonicalize_clips(
    df: DataFrame, content: str = "content", path: str = "clip_path", on_error: str = "fail"
) -> DataFrame:
    """Every clip as 16 kHz mono PCM16 WAV in ``bytes``. The first bad clip fails the job by name,
    or with ``on_error='quarantine'`` bad rows stay, with null bytes and an ``error``."""
    return settle_errors(try_canonicalize_clips(df, content, path), on_error)
