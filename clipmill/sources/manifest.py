"""Strict reading of JSONL manifests."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import ExitStack, contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipmill import storage
from clipmill.functions.text import clean_text
from clipmill.operators.validate import ManifestError
from clipmill.schemas import MANIFEST, wire_name


def nonblank_lines(lines: DataFrame) -> DataFrame:
    """``line, file`` of the lines that hold more than white space."""
    return lines.where(F.rlike("value", F.lit(r"(?U)\S"))).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file")
    )


def manifest_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines with their file. Only a line feed ends a line."""
    return nonblank_lines(spark.read.option("lineSep", "\n").text(path))


def _accepts(kind: Column, field: T.StructField) -> Column:
    """Whether a JSON value of this variant type may stand for the field."""
    if isinstance(field.dataType, T.StringType):
        return kind == "STRING"
    if isinstance(field.dataType, T.DoubleType):
        return kind.isin("BIGINT", "DOUBLE") | F.startswith(kind, F.lit("DECIMAL"))
    return kind == "BIGINT"


def _problem(record: Column) -> Column:
    """Why a line is not a manifest record, or null."""
    problem = F.when(record["document_kind"].isNull(), F.lit("not valid JSON")).when(
        ~F.startswith(record["document_kind"], F.lit("OBJECT")), F.lit("not a JSON object")
    )
    for field in MANIFEST.fields:
        kind, name = record["kinds"][field.name], wire_name(field.name)
        absent = kind.isNull() | (kind == "VOID")
        if not field.nullable:
            problem = problem.when(absent, F.lit(f"field {name} is missing"))
        problem = problem.when(
            ~absent & ~_accepts(kind, field), F.concat(F.lit(f"field {name} has the wrong type "), kind)
        )
        if isinstance(field.dataType, T.IntegerType):
            problem = problem.when(record[field.name].isNull(), F.lit(f"field {name} is out of range"))
    return problem


def parse_manifest(lines: DataFrame, *also: str) -> DataFrame:
    """``line, file`` rows to manifest columns plus ``problem`` (null for good lines), keeping columns ``also``.

    Lines go through the variant type, which keeps JSON kinds apart: a number where a string
    belongs, a repeated key or an array is a problem, not a silent conversion.
    """

    def read(document: Column) -> Column:
        values, kinds = [], []
        for f in MANIFEST.fields:
            path = f"$.{wire_name(f.name)}"
            values.append(F.try_variant_get(document, path, f.dataType.simpleString()).alias(f.name))
            kinds.append(F.schema_of_variant(F.try_variant_get(document, path, "variant")).alias(f.name))
        whole = F.schema_of_variant(document).alias("document_kind")
        return F.struct(*values, F.struct(*kinds).alias("kinds"), whole)

    def check(record: Column) -> Column:
        values = [record[name].alias(name) for name in MANIFEST.fieldNames()]
        return F.struct(*values, _problem(record).alias("problem"))

    # One-element arrays, so that each step is computed once per line: the optimizer would copy
    # plain columns into every expression that uses them.
    documents = F.array(F.try_parse_json(clean_text(F.col("line"))))
    return lines.select("line", "file", *also, F.inline(F.transform(F.transform(documents, read), check)))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest records of a file or directory. A bad line fails the job, naming file and line text;
    :func:`staged_manifest` names its number too."""
    return checked_records(parse_manifest(manifest_lines(spark, path)))


def checked_records(parsed: DataFrame) -> DataFrame:
    message = F.concat(F.col("file"), F.lit(": invalid manifest line, "), F.col("problem"), F.lit(": "), F.col("line"))
    fine = F.when(F.col("problem").isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return parsed.where(fine).select(MANIFEST.fieldNames())


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines :func:`read_manifest` would refuse: ``file, number, line, problem``.

    Spark cuts a large file into blocks that tasks read on their own, so no task knows how many lines
    stand before its block. Lines are counted by block, and sums over a file's blocks give the number
    of a block's first line; within a block a line's number follows from the order in which its task
    read it. Counts move between tasks, one row for each block and task; lines do not.
    """
    block = ["file", "block"]
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),  # rises by one from line to line of a task
    )
    counts = lines.groupBy(*block).agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*block, "first", F.coalesce(before, F.lit(0)).alias("before"))
    held = lines.where(F.rlike("value", F.lit(r"(?U)\S"))).withColumnRenamed("value", "line")
    parsed = parse_manifest(held, "block", "place").where(F.col("problem").isNotNull())
    number = (F.col("before") + F.col("place") - F.col("first") + 1).alias("number")
    return parsed.join(starts, block).select("file", number, "line", "problem")


def _located(spark: SparkSession, path: str) -> ManifestError | None:
    """The first bad line of a manifest as an error that says where it is."""
    bad = bad_lines(spark, path)
    one = bad.agg(F.count("*").alias("n"), F.min(F.struct("file", "number", "problem", "line")).alias("first")).head()
    if not one.n:
        return None
    first = one["first"]
    more = f" (and {one.n - 1} more bad lines)" if one.n > 1 else ""
    return ManifestError(f"{first.file}:{first.number}: invalid manifest line, {first.problem}: {first.line}{more}")


@contextmanager
def staged_manifest(
    spark: SparkSession, records: DataFrame, path: str | None = None, lines: DataFrame | None = None
) -> Iterator[DataFrame]:
    """Checked records as a table for the length of a job; a bad line is an error with file and number.

    Lines are numbered only then: in the manifest at ``path``, or, for a batch of ``lines`` with their
    files, in the first file of the batch that holds a bad one.
    """
    with ExitStack() as open_:
        try:
            manifest = open_.enter_context(storage.staged(records, "manifest"))
        except PySparkException as failure:
            if path is None and lines is not None:
                bad = parse_manifest(lines).where(F.col("problem").isNotNull())
                path = bad.agg(F.min("file")).head()[0]
            located = _located(spark, path) if path else None
            if located is None:
                raise
            raise located from failure
        yield manifest
