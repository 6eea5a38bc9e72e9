import os
import random
from zlib import crc32

import numpy as np
import pytest
from cases import SCHEMA, awkward, prose

from clipmill.llm import common, queries, quality_classifier, toxicity

SF_DIR = "/root/testdata/sf0.01"


def good_and_bad(n):
    rows, labels = [], []
    for i in range(n):
        text = prose(20 + i % 50, i)
        bad = i % 3 == 0
        rows.append((i, text.upper().replace(" ", "!! ") if bad else text))
        labels.append((i, int(not bad), None))
    return rows, labels


def test_quality_on_unseen_documents(spark):
    rows, labels = good_and_bad(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([x for x in labels if x[0] < 240], "doc_id long, quality int, toxic int")
    model = quality_classifier.train(docs, known)
    got = {r.doc_id: r for r in quality_classifier.score(docs, model).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    right = [got[i].predicted == y for i, y, _ in labels[240:]]
    assert np.mean(right) > 0.95


def test_samples_do_not_depend_on_the_order_of_rows(spark):
    """Ids with several texts, null ids and texts, ids of both classes: reruns learn the same."""
    rows, labels = good_and_bad(120)
    rows += [(i, prose(30, 1000 + i)) for i in range(60)] + [(None, "none"), (3, None), (4, "")]
    labels += [(i, 0, 1) for i in range(5)] + [(i, 1, 0) for i in range(10)] + [(None, 1, 1), (7, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    texts = docs.selectExpr("doc_id i", "text t").where("octet_length(t) > 0")
    seen = []
    for parts in (1, 7):
        mixed = texts.repartition(parts, "t"), known.selectExpr("doc_id i", "quality y").where("i is not null").repartition(parts)
        seen.append(sorted(map(tuple, common.labelled_texts(*mixed, 50).collect())))
        for model in (quality_classifier.train(docs.repartition(parts, "text"), known), toxicity.train(docs.repartition(parts, "text"), known)):
            seen.append(model.scores(["a fair text", prose(40, 77), prose(40, 78).upper()]).tolist())
    assert seen[:3] == seen[3:]
    by_id = {}
    for i, t in rows:
        if i is not None and t:
            by_id.setdefault(i, set()).add(t)
    assert all(t in by_id[i] for _, i, _, t in seen[0]) and len({(y, i) for y, i, _, _ in seen[0]}) == len(seen[0])
    assert {y: sum(r[0] == y for r in seen[0]) for y in (0, 1)} == {0: 43, 1: 50}  # 40 bad ids and three more


def test_quality_does_not_depend_on_length_or_batches():
    good = [prose(80, i).encode() for i in range(60)]
    bad = [prose(80, i).upper().encode() for i in range(60)]
    model = quality_classifier.Model(good, bad, quality_classifier.Fit())
    long = [prose(4000, 900), prose(4000, 901).upper()]
    scores = model.scores(long)
    assert scores[0] > 0.9 and scores[1] < 0.1 and scores[1] == model.scores(long[1:])[0]


def test_quality_learns_from_whole_texts_at_the_full_sample():
    head = prose(60, 1)  # over 200 bytes that all texts begin with
    good = [f"{head} {prose(60, i)}".encode() for i in range(2000)]
    bad = [f"{head} {prose(60, -i).upper()}".encode() for i in range(2000)]
    model = quality_classifier.Model(good, bad, quality_classifier.Fit())
    scores = model.scores([f"{head} {prose(60, 5000 + i)}" for i in range(20)])
    assert scores.min() > 0.9
    scores = model.scores([f"{head} {prose(60, 6000 + i).upper()}" for i in range(20)])
    assert scores.max() < 0.1


def test_quality_dictionaries_hold_the_same_bytes_of_a_text_at_every_size():
    model = quality_classifier.Model([], [], quality_classifier.Fit())
    short, long = prose(20, 1).encode(), prose(4000, 2).encode()
    parts = model._windows(long)
    assert model._windows(short) == [short] and sum(map(len, parts)) == 512
    places = [long.index(p) * 4 // len(long) for p in parts]
    assert places == [0, 1, 2, 3]
    for n in (3, 3000):
        assert model._dictionary([long] * n + [short]) == b"".join(parts) * n + short


MILD = ("blorgish", "snivel", "gronk")


def toxic_texts(n, seed=0):
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = prose(30 + i % 40, seed * 10_000 + i).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(MILD))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_on_unseen_documents_and_misspellings(spark):
    rows = toxic_texts(400)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], None, r[2]) for r in rows if r[0] < 260], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert np.mean([got[i].predicted == y for i, _, y in rows[260:]]) > 0.95
    base = model.scores([prose(40, 5)])[0]
    assert min(model.scores([f"{prose(20, 6)} {w} {prose(20, 7)}" for w in ("blorgishh", "snivell", "BLORGISH")])) > max(0.5, base)


def test_toxicity_scores_equal_word_by_word():
    rows = toxic_texts(80)
    model = toxicity.Model([t for _, t, y in rows if y], [t for _, t, y in rows if not y], toxicity.Fit(rounds=15))
    e, u, b = model.weights["e"], model.weights["u"], model.weights["b"]
    for text in (rows[0][1], rows[1][1], "Äpfel"):
        clean = 1.0
        for word in toxicity.distinct_words(text):
            flat, counts = toxicity.subwords([word], model.fit.buckets)
            assert counts.tolist() == [sum(max(len(word) + 3 - n, 0) for n in (3, 4, 5)) + 1]
            out = e[flat].mean(0) @ u + b
            clean *= np.exp(out[0]) / np.exp(out).sum()  # the softmax's first class
        assert model.scores([text])[0] == pytest.approx(1 - clean, abs=1e-4)


def test_toxicity_of_clean_documents_does_not_rise_with_length():
    rng, toxic, clean = random.Random(4), [], []
    for i in range(240):
        words = prose(rng.choice((20, 60, 200, 600)), 40_000 + i).split()
        if i % 3 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(MILD))
        (clean if i % 3 else toxic).append(" ".join(words))
    model = toxicity.Model(toxic, clean, toxicity.Fit())
    long = [prose(6000, 50_000 + i) for i in range(60)]
    assert np.mean(model.scores(long) >= 0.7) <= 0.05
    assert np.mean(model.scores([prose(40, 60_000 + i) for i in range(60)]) >= 0.7) <= 0.05
    assert np.mean(model.scores([f"{t} {' '.join(MILD)}" for t in long]) >= 0.7) > 0.9


@pytest.mark.parametrize("kind", [quality_classifier, toxicity])
def test_awkward_rows(spark, kind):
    df = spark.createDataFrame([(*r, "x") for r in awkward()], SCHEMA + ", Score string")
    rows, labels = good_and_bad(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    twice = [(i, y, 1 - y) for i, y, _ in labels] * 2 + [(None, 1, 1), (3, None, None)]
    model = kind.train(docs, spark.createDataFrame(twice, "doc_id long, quality int, toxic int"))
    got = kind.score(df, model).collect()
    assert len(got) == len(awkward()) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    none = kind.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.score for r in kind.score(df, none).collect()} == {none.base}
    assert kind.score(df.where("false"), model).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are not here")
def test_queries_learn_nothing_from_the_held_out_fold(spark):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    for name, folds, fold, label in (("op8_quality_classifier", 4, 2, "quality"), ("op5_toxicity", 3, 1, "toxic")):
        rows = queries.QUERIES[name](spark, SF_DIR).collect()
        assert all(r.held_out == (crc32(str(r.doc_id).encode()) % folds == fold) for r in rows)
        right = [r.predicted == labels[r.doc_id][label] for r in rows if r.held_out and r.doc_id in labels]
        assert len(right) > 50 and np.mean(right) > 0.85
