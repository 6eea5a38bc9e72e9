import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from cases import SCHEMA, awkward, prose

from clipmill.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, k=10):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    bags = [(i, Counter(terms(x))) for i, x in docs if terms(x)]
    n_all, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item_id, text in items:
        found = []
        for doc_id, bag in bags:
            m = 10 + 90 * sum(bag.values()) * n_all // length
            score = sum(
                math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m))
                for t in set(terms(text)) & bag.keys()
            )
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, r + 1, None if lost else i, -s) for r, (s, lost, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def search(spark, docs, items, k=10, parts=5):
    docs = spark.createDataFrame(docs, DOCS).repartition(parts)
    got = ls.search(docs, spark.createDataFrame(items, ITEMS), k).collect()
    return sorted((tuple(r) for r in got), key=str)


def corpus(n, seed):
    """Few words, so that masks and scores repeat."""
    rng = random.Random(seed)
    words = [prose(1, i) for i in range(60)]
    draw = lambda size: " ".join(words[min(int(rng.expovariate(0.08)), 59)] for _ in range(size))
    return [(i, draw(rng.choice((1, 3, 20, 80)))) for i in range(n)], [(i, draw(rng.choice((1, 4, 12)))) for i in range(15)]


@pytest.mark.parametrize("k", [1, 10])
def test_results_equal_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(ls, "BLOCK_DOCS", 40)  # blocks of a task share the threshold
    docs, items = corpus(600, 1)
    docs += [(1000 + i, docs[3][1]) for i in range(30)]  # ties beyond the k-th place
    assert search(spark, docs, items, k) == brute(docs, items, k)


def test_queries_of_many_terms_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ls, "BLOCK_ITEMS", 3)
    docs = [(i, prose(60, i % 90) + (" the" * (i % 4))) for i in range(150)]
    items = [(i, prose(130, i)) for i in range(8)] + [(8, "THE the, The!"), (9, "no such word"), (10, None), (11, "")]
    assert len(set(terms(items[0][1]))) > ls.BITS
    assert search(spark, docs, items) == brute(docs, items)


def test_terms():
    assert ls.terms_of("Ab_c1-É漢X\x00y{z") == [x.encode() for x in ("ab", "c1", "É漢x", "y", "z")]
    for text in ("a\x7fb `c´ 😀d", prose(20), "", "\n"):
        assert [x.decode() for x in ls.terms_of(text)] == terms(text)


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(*r, 1, "x") for r in awkward()], SCHEMA + ", score int, query string")
    rows = [(9, prose(60, 3)), (9, prose(60, 3)), (None, "é"), (1, None)]
    items = spark.createDataFrame([(*r, 5) for r in rows], "item_id long, text string, doc_id int")
    got = sorted((tuple(r) for r in ls.search(docs, items).collect()), key=str)
    assert got == brute([r[:2] for r in awkward()], rows)
    assert [r[2] for r in got if r[0] == 9][:4] == [5, 5, 5, 5]  # a repeated document, for a repeated item
    assert ls.search(docs.where("false"), items).count() == 0 == ls.search(docs, items.where("false")).count()


def test_few_documents_are_evaluated():
    docs, items = corpus(4000, 2)
    queries = ls.Queries([x for _, x in items])
    words = [ls.terms_of(x) for _, x in docs]
    found = [queries.counts(w) for w in words]
    holders = Counter(t for f, _ in found for t in f.tolist())
    weights = ls.Weights(len(docs), sum(map(len, words)), [holders[t] for t in range(len(queries.number))])
    block = ls.Block([i for i, _ in docs], found, [len(w) for w in words], weights)
    best = [ls.Best(10) for _ in items]
    for one, own in zip(best, queries.terms):
        one.search(block, own)
    want = brute(docs, items)
    got = [(i, r + 1, int(d), int(s)) for (i, _), b in zip(items, best) for r, (d, s) in enumerate(zip(b.id, b.score))]
    assert sorted(got, key=str) == want
    assert sum(b.evaluated for b in best) < 0.5 * len(docs) * len(items)


def test_items_and_results_are_kept_in_few_files(spark, conf, monkeypatch):
    conf("spark.sql.shuffle.partitions", "40")
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    kept, cut = [], ls.cut
    monkeypatch.setattr(ls, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    docs, items = corpus(50, 3)
    tables = [pa.table(list(zip(*rows)), names) for rows, names in ((docs, ["doc_id", "text"]), (items, ["item_id", "text"]))]
    found = ls.search(*map(spark.createDataFrame, tables))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(docs, items)
    few = spark.sparkContext.defaultParallelism
    assert [df.rdd.getNumPartitions() for df in kept] == [few] == [found.rdd.getNumPartitions()]
    assert "PythonRDD" not in found._jdf.queryExecution().toRdd().toDebugString()  # Python workers beside the search's
