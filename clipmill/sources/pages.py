"""Catalogue rows from saved listing pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipmill.schemas import PAGE_DEFAULTS, PAGE_ITEMS, wire_name, wire_schema


def _envelopes(spark: SparkSession, path: str) -> DataFrame:
    """``text`` of each page envelope below a path; tasks read blocks of files, not whole files.

    JSON strings hold no raw line feed, so an envelope begins at a line starting with ``{`` after a line
    ending with ``}``: inside one, a comma or bracket stands between. Spark cuts files into blocks at
    lines. The lines of a block are put together to pieces in one task; pieces that touch an end of their
    block, two for each at most, are then joined across blocks. A block whose first line starts with ``{``
    begins an envelope if the last line before it ended with ``}``.
    """
    block = ["file", "block"]
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),  # rises from line to line of a task
        F.regexp_replace("value", r"^[ \t\r]+|[ \t\r]+$", "").alias("line"),
    )
    lines = lines.where("line != ''").withColumn("opens", F.startswith("line", F.lit("{")))
    in_block = Window.partitionBy(*block).orderBy("place")
    after = F.coalesce(F.lag(F.endswith("line", F.lit("}"))).over(in_block), F.lit(False))
    runs = lines.withColumn("begins", (F.col("opens") & after).cast("int"))
    runs = runs.withColumn("run", F.sum("begins").over(in_block.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = F.array_sort(F.collect_list(F.struct("place", "line", "opens")))
    pieces = runs.groupBy(*block, "run").agg(ordered.alias("lines")).select(
        *block,
        "run",
        F.col("lines")[0]["opens"].alias("opens"),
        F.array_join("lines.line", "\n").alias("text"),
    )
    # Pieces are already together by block; those inside a block are whole envelopes.
    last = F.max("run").over(Window.partitionBy(*block))
    pieces = pieces.withColumn("inner", (F.col("run") > 0) & (F.col("run") < last))
    in_file = Window.partitionBy("file").orderBy("block", "run")
    ends = pieces.where("not inner").drop("inner")
    before = F.lag(F.endswith("text", F.lit("}"))).over(in_file)
    starts = F.coalesce(F.col("opens") & before, F.lit(True)).cast("int")
    ends = ends.withColumn("starts", starts)
    ends = ends.withColumn("number", F.sum("starts").over(in_file.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("block", "run", "text")))
    joined = ends.groupBy("file", "number").agg(F.array_join(parts["text"], "\n").alias("text"))
    return pieces.where("inner").select("text").unionAll(joined.select("text"))


def read_pages(spark: SparkSession, path: str, item_key: str) -> DataFrame:
    """Rows of all page envelopes ``{<item_key>: [...], page, pageSize, ...}`` below a path.

    A file holds one envelope or several, one after the other. A page that is not JSON or lacks its
    items, or an item without a required field, fails the job. Nested JSON (filter, split policy,
    label set) stays JSON text.
    """
    if item_key not in PAGE_ITEMS:
        raise ValueError(f"unknown page items {item_key!r}; expected one of {tuple(PAGE_ITEMS)}")
    record = PAGE_ITEMS[item_key]
    envelope = T.StructType([T.StructField(item_key, T.ArrayType(wire_schema(record)))])
    listed = F.concat(F.lit("["), "text", F.lit("]"))
    pages = _envelopes(spark, path).select(F.inline(F.from_json(listed, T.ArrayType(envelope), {"mode": "FAILFAST"})))
    no_items = F.raise_error(F.lit(f"page without {item_key}")).cast(pages.schema[item_key].dataType)
    items = pages.select(F.inline(F.coalesce(item_key, no_items)))

    def column(f: T.StructField):
        value = F.col(wire_name(f.name))
        if f.name in PAGE_DEFAULTS:
            value = F.coalesce(value, F.lit(PAGE_DEFAULTS[f.name]).cast(f.dataType))
        elif not f.nullable:
            refusal = F.raise_error(F.lit(f"{item_key} item without {wire_name(f.name)}")).cast(f.dataType)
            value = F.coalesce(value, refusal)
        return value.alias(f.name)

    return items.select(*[column(f) for f in record.fields])
