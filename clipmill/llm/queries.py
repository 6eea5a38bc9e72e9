"""One query per operator over the given tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmill import storage
from clipmill.llm import decontaminate, html_extract, lexical_search, mixing, near_dedup, quality_classifier, quality_rules, sharding
from clipmill.llm import token_counts, token_files, toxicity, url_rules, vector_codes
from clipmill.llm.common import in_fold
from clipmill.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and verdict of every document."""
    rows = quality_rules.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ~quality_rules.passes(quality_rules.BASE)
    return rows.select(
        "doc_id",
        *quality_rules.MEASURES,
        "failed_bits",
        base.alias("base_failed"),
        (~base & quality_rules.passes(quality_rules.STRICT)).alias("kept"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage in every document; documents without one are clean and have no row."""
    documents, benchmark = (_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return decontaminate.find_passages(documents, benchmark)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, each document encoded once."""
    documents = _table(spark, sf_dir, "documents")
    return token_counts.attribute(documents, token_counts.read_vocabulary())


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's share in the mix of all sources."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.plan(documents).drop("text", "source")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; the fold with remainder 1 of 3 teaches nothing."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(~in_fold(F.col("doc_id"), 3, 1))
    rows = toxicity.score(documents, toxicity.train(documents, labels))
    return rows.select("doc_id", in_fold(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot on a ring of 16 shards."""
    return sharding.shard(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of near copies."""
    return near_dedup.link_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality; the fold with remainder 2 of 4 teaches nothing."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(~in_fold(F.col("doc_id"), 4, 2))
    model = quality_classifier.train(documents, labels)
    rows = quality_classifier.score(documents, model)
    return rows.select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict; a page is labelled through the document whose number ends its path."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract(url_rules.path_of(F.col("url")), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    numbered = pages.select("url", number.try_cast("long").alias("doc_id"))
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id").agg((F.max("quality") == 0).alias("block"))
    mined = url_rules.mine(numbered.join(labels, "doc_id").select("url", "block"))
    return url_rules.judge(pages, mined).drop("url")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages, html_extract.train(pages)).drop("html")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and digest in token files, read back from them."""
    vocabulary = Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8")
    path = storage.scratch_dir(spark, "token-files")
    documents = _table(spark, sf_dir, "documents")
    token_files.write(documents, path, vocabulary, end_id=2, by_word=True, keep=("lang", "source"))
    return token_files.digests(token_files.read(spark, path))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return lexical_search.search(*(_table(spark, sf_dir, t) for t in ("documents", "benchmark")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code of eight parts, with errors and the digest of the codebooks."""
    return vector_codes.encode(_table(spark, sf_dir, "embeddings")).drop("label")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_decontamination": op2_decontamination,
    "op3_token_counts": op3_token_counts,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_sharding": op6_sharding,
    "op7_near_dedup": op7_near_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_url_filter": op9_url_filter,
    "op10_html_extraction": op10_html_extraction,
    "op11_token_files": op11_token_files,
    "op12_lexical_search": op12_lexical_search,
    "op13_vector_codes": op13_vector_codes,
}
