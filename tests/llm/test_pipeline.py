import os
import random

import pytest
from cases import SCHEMA, awkward, prose
from test_near_dedup import brute, variants

import corpus_pipeline as c

SF_DIR = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are not here")


def test_stages_on_the_given_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(c.STAGES):
        out = stage(spark, docs, SF_DIR)
        out.write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        assert after.columns == columns or k == len(c.STAGES) - 1
        kept[name] = (docs, after)
        docs = after
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    good = kept["quality"][0].join(labels.where("quality = 1"), "doc_id").count()
    assert kept["quality"][1].join(labels.where("quality = 1"), "doc_id").count() > 0.95 * good
    before, after = kept["near_dedup"]
    assert after.count() == before.select("text").distinct().count() or after.count() < before.count()
    assert after.count() == after.select("doc_id").distinct().count()
    before, after = kept["decontaminate"]
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    holds = lambda r: any(i in " ".join(r.text.lower().split()) for i in items)
    assert not any(map(holds, after.collect()))
    assert {r.doc_id for r in before.collect() if not holds(r)} == {r.doc_id for r in after.collect()}
    before, after = kept["mix"]
    assert max(r["count"] for r in after.groupBy("doc_id").count().collect()) <= 2
    assert kept["shard"][1].count() == kept["shard"][0].count()
    assert kept["shard"][1].groupBy("shard", "slot").count().where("count > 1").count() == 0


def test_every_stage_survives_awkward_and_empty_tables(spark):
    docs = spark.createDataFrame(awkward() + [(i, prose(30, i), "en", "c", 1) for i in range(20, 40)], SCHEMA)
    for name, stage in c.STAGES:
        out = stage(spark, docs, SF_DIR)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        rows = out.collect()
        assert len(rows) <= 2 * docs.count()
        if name == "near_dedup":
            assert sorted(str(r.doc_id) for r in rows).count("5") == 1 and len(rows) == docs.count() - 1
        assert stage(spark, docs.where("false"), SF_DIR).count() == 0


def test_near_dedup_equals_brute_force_at_80_percent(spark):
    texts = [prose(40 + i, i) for i in range(30)]
    for k, (n, changes) in enumerate([(10, 1), (20, 2), (30, 3), (20, 4), (10, 6)]):
        texts += variants(prose(150, 700 + k), n, changes, k)
    for k in range(25):  # pairs whose similarity is known: two copies with 4 to 28 more words on one
        words = prose(100, 800 + k).split()
        texts += [" ".join(words), " ".join(words + prose(4 + k, 900 + k).split())]
    rows = list(enumerate(texts))
    random.Random(2).shuffle(rows)
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], SCHEMA)
    kept = {r.doc_id for r in dict(c.STAGES)["near_dedup"](spark, docs, SF_DIR).collect()}
    want = {i for i, (_, root) in brute(rows, 80).items() if i == root}
    assert kept == want
    assert want < {i for i, (_, root) in brute(rows, 85).items() if i == root}
