"""Small driver-side file operations through Hadoop's FileSystem, so every scheme works."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def join(root: str, *parts: str) -> str:
    return "/".join([root.rstrip("/"), *parts])


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def qualify(spark: SparkSession, path: str) -> str:
    """The path with scheme and authority, as the file sources report it."""
    fs, p = _fs(spark, path)
    return fs.makeQualified(p).toString().rstrip("/")


def make_dirs(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.mkdirs(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, src: str, dst: str) -> None:
    fs, p = _fs(spark, src)
    if not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(dst)):
        raise OSError(f"could not move {src} to {dst}")


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode("utf-8"))


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    fs, p = _fs(spark, path)
    source = fs.open(p)
    try:
        return bytes(source.readAllBytes()).decode("utf-8")
    finally:
        source.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """What a directory holds, sorted; nothing for one that is not there."""
    fs, p = _fs(spark, path)
    return sorted(status.getPath().getName() for status in fs.listStatus(p)) if fs.exists(p) else []


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all; its name must not be taken."""
    folder, _, name = path.rpartition("/")
    partial = join(folder, f"_{name}.{uuid.uuid4().hex}")
    write_text(spark, partial, text)
    if exists(spark, path):
        raise FileExistsError(path)
    rename(spark, partial, path)


_local_roots: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Where it is unset, a local-mode session gets one temporary folder for the process, removed at its
    end; on a cluster the setting must be given.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if not _local_roots:
        _local_roots.append(tempfile.mkdtemp(prefix="clipmill-"))
        atexit.register(shutil.rmtree, _local_roots[0], ignore_errors=True)
    return _local_roots[0]


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh directory in the shared folder."""
    path = join(shared_root(spark), f"{label}-{uuid.uuid4().hex}")
    make_dirs(spark, path)
    return path


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session option for the length of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows as written to the shared checkpoint folder, with the lineage cut there."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def staged(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """The rows as a Parquet table in the shared folder, for the length of a job.

    Later steps read the columns they need instead of computing ``df`` again, and a lost executor
    costs no more than its own tasks.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    try:
        df.write.mode("overwrite").parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        remove(spark, path)
