"""From raw documents to shards of training text, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; its rows are written as Parquet and
read again as the next stage's documents. All but the last return the columns of the documents.

    quality        rejects documents that the compression classifier, trained on `labels`, calls bad
    near_dedup     keeps one document of each group of near copies: five-word shingles, Jaccard 0.80 or more
    decontaminate  drops documents that hold a passage of `benchmark`
    mix            repeats documents so that sources come near their target weights
    shard          places every row on one of 16 shards

Defined results beside those of the operators: a document without an id is told apart by its text in
`near_dedup`; of rows with equal ids and texts one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmill import storage
from clipmill.llm import decontaminate, mixing, near_dedup, quality_classifier, sharding
from clipmill.llm.common import cut, quoted


#: Links of the near_dedup stage. A pair at 0.80 meets in one of the 20 x 20 tables with a probability over
#: 0.9999 (12 x 12 would give 0.996). The query op7_near_dedup has its own bound, 85.
NEAR = near_dedup.Banding(tables=20, percent=80)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality_classifier.score(docs, quality_classifier.train(docs, labels))
    return scored.where("predicted = 1").select(*[F.col(quoted(c)) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    by_text = -1 - F.xxhash64(F.col("text")).bitwiseAND((1 << 62) - 1)
    key = F.coalesce(F.col("doc_id").cast("long"), by_text)
    groups = near_dedup.link_components(docs.select(key.alias("doc_id"), "text"), NEAR)
    kept = cut(groups.where("kept").groupBy(F.col("doc_id").alias("_kept")).agg(F.count("*").alias("_rows")))
    once = docs.join(kept.where("_rows = 1"), key == F.col("_kept"), "left_semi")
    more = docs.join(kept.where("_rows > 1"), key == F.col("_kept"), "left_semi").dropDuplicates(["doc_id", "text"])
    return once.union(more)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.draw(mixing.plan(docs)).select(*[F.col(quoted(c)) for c in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_copies),
    ("decontaminate", leaks),
    ("mix", mix),
    ("shard", shard),
]

#: SQL can express neither the classifier nor the ring; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; stages are written to the shared folder on the way.

    A stage's table is removed when the next is written; that of the last but one stays for the result.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            folder = storage.scratch_dir(spark, f"stage-{name}")
            docs.write.parquet(storage.join(folder, "rows"))
            docs = spark.read.parquet(storage.join(folder, "rows"))
            if before:
                storage.remove(spark, before)
            before = folder
    return docs
