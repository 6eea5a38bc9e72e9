import os
import random

import numpy as np
import pytest
from cases import SCHEMA, awkward, prose
from pyspark.sql import functions as F

from clipmill import storage
from clipmill.llm import near_dedup, shingles
from clipmill.llm.components import components


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows, percent=85):
    """Component ids by all pairs; rows of one id are taken to be one text."""
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def variants(base, n, changes, seed):
    rng = random.Random(seed)
    for _ in range(n):
        words = base.split()
        for _ in range(changes):
            words[rng.randrange(len(words))] = prose(1, rng.random())
        yield " ".join(words)


def test_groups_equal_brute_force(spark):
    texts = [prose(40 + i, i) for i in range(40)]
    for k, (n, changes) in enumerate([(30, 1), (20, 2), (15, 4), (10, 8)]):
        texts += variants(prose(120, 500 + k), n, changes, k)
    texts += [prose(90, 900)] * 12 + [prose(90, 900).upper(), "a b", "A  b", "a b c", "", None]
    shared = prose(60, 950)
    texts += [f"{shared} {prose(15, 1000 + i)}" for i in range(25)]
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    got = near_dedup.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_awkward_rows(spark):
    df = spark.createDataFrame(awkward(), SCHEMA)
    got = near_dedup.link_components(df).collect()
    assert len(got) == len(awkward())
    by_id = {r.doc_id: r for r in got}
    assert by_id[None].component_id is None and by_id[1].n_shingles == 0 and by_id[3].component_id == 3
    assert [r.kept for r in got if r.doc_id == 5] == [True, True]
    assert near_dedup.link_components(df.where("false")).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_links_of_full_sets(percent, monkeypatch):
    monkeypatch.setattr(near_dedup, "_SHINGLES", 64)
    texts = [t.encode() for t in [*variants(prose(120, 1), 12, 2, 1), *variants(prose(90, 2), 8, 4, 2), prose(300, 3), "one two"]]
    sets = shingles.shingle_sets(texts, 5)
    sets.append(sets[0][:-1])
    want = set()
    for i, x in enumerate(sets):
        for j in range(i + 1, len(sets)):
            same = len(np.intersect1d(x, sets[j]))
            if same and 100 * same >= percent * (len(x) + len(sets[j]) - same):
                want.add((i, j))
    got = set(zip(*(x.tolist() for x in near_dedup.linked(sets, percent))))
    assert {(i, j) for i, j in got if i < j} == want and want


def test_large_buckets_and_clusters_meet_in_blocks(spark, monkeypatch):
    """A loose cluster, hardly a link in it, and a tight one, cut into many blocks."""
    monkeypatch.setattr(near_dedup, "NODES", 16)
    monkeypatch.setattr(near_dedup, "SETS", 8)
    texts = [*variants(prose(120, 70), 90, 3, 5), *variants(prose(150, 71), 60, 1, 6)]
    rows = list(enumerate(texts))
    random.Random(2).shuffle(rows)
    got = near_dedup.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_sketches_rule_out_pairs_and_keep_links():
    banding = near_dedup.Banding()
    sets = shingles.shingle_sets([t.encode() for t in variants(prose(120, 80), 400, 3, 9)], 5)
    _, sketch = banding.signatures(sets)
    pairs = [(i, j) for i in range(400) for j in range(i + 1, 400)]
    a, b = (np.array(x) for x in zip(*pairs))
    kept = ((sketch[a] == sketch[b]).sum(axis=1) >= banding.least_equal).mean()
    assert kept < 0.25  # pairs of about 0.6
    close = [*variants(prose(400, 81), 60, 1, 3)]
    _, sketch = banding.signatures(shingles.shingle_sets([t.encode() for t in close], 5))
    assert ((sketch[:1] == sketch).sum(axis=1) >= banding.least_equal).all()


def test_tasks_send_nodes_not_pairs(spark):
    """A loose cluster of 300 nodes has 44,850 pairs; each table key sends a row a node at most."""
    docs = spark.createDataFrame(list(enumerate(variants(prose(120, 82), 300, 3, 4))), "id long, text string")
    banding = near_dedup.Banding()
    nodes = near_dedup._signatures(docs, banding).withColumn("rep", F.col("id")).cache()
    sent = near_dedup._clusters(nodes, banding)
    assert sent.count() <= 300 * banding.tables
    links = near_dedup._links(docs, nodes, components(sent), banding)
    assert links.count() < 300 * 3  # blocks of one cluster
    nodes.unpersist()


def test_nothing_is_left_in_the_shared_folder(spark):
    root = storage.shared_root(spark)
    before = set(os.listdir(root))
    docs = spark.createDataFrame(list(enumerate(variants(prose(60, 5), 20, 1, 1))), "doc_id long, text string")
    assert near_dedup.link_components(docs).count() == 20
    left = set(os.listdir(root)) - before
    assert all(len(name) == 36 or name.startswith("package") for name in left), left  # checkpoints, one folder a session


def test_labels_reach_along_chains():
    a = np.arange(0, 99)
    assert near_dedup.labels_of(101, a, a + 1).tolist() == [0] * 100 + [100]
    assert near_dedup.labels_of(3, np.array([], dtype=int), np.array([], dtype=int)).tolist() == [0, 1, 2]


def test_word_hashes_do_not_depend_on_neighbours():
    alone, _ = shingles.word_hashes([b"Alpha beta"])
    among, first = shingles.word_hashes([b"x  y", b"", b"ALPHA\tBETA", b"z"])
    assert first.tolist() == [0, 2, 2, 4, 5] and (among[2:4] == alone).all()


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(150)] + [("z1", "z2")], "a string, b string")
    got = {r.node: r.comp for r in components(links).collect()}
    assert len(got) == 153 and {got[f"n{i:03}"] for i in range(151)} == {"n000"} and got["z2"] == "z1"
