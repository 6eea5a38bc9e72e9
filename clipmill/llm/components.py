"""Connected components of a link table, by passing the smallest label and shortcutting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmill import storage
from clipmill.llm.common import MERGE, cut


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b): comp is the smallest node it can reach.

    Each round a node takes the smallest label among its neighbours', then the label of that label,
    so a round doubles the reach. Labels and links stay in tables; the driver sees a count only. A round's
    table is removed when the next is written.
    """
    spark = links.sparkSession
    folder = storage.scratch_dir(spark, "components")

    def written(df: DataFrame, name: str) -> DataFrame:
        path = storage.join(folder, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        links = written(links.select("a", "b").distinct(), "links")
        edges = written(links.union(links.select("b", "a")).distinct(), "edges")
        labels = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp"))
        labels, k = written(labels, "labels-0"), 0
        while True:
            heard = edges.join(labels.hint(MERGE), edges.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
            lower = labels.join(heard.hint(MERGE), "node", "left").select(
                "node", "comp", F.least("comp", F.coalesce("m", "comp")).alias("next")
            )
            jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
            moved = lower.join(jump.hint(MERGE), "next", "left").select("node", "comp", F.least("next", F.coalesce("far", "next")).alias("next"))
            k += 1
            moved = written(moved, f"labels-{k}")
            labels = moved.select("node", F.col("next").alias("comp"))
            storage.remove(spark, storage.join(folder, f"labels-{k - 1}"))
            if moved.where("comp != next").isEmpty():
                return cut(labels)
    finally:
        storage.remove(spark, folder)
