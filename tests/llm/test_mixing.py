from collections import Counter, defaultdict

from cases import SCHEMA, WORD, awkward, prose
from pyspark.sql import functions as F

from clipmill.llm import mixing


def filled(sizes, weights=(3, 1, 2), budget=1.5, most=2):
    """Targets by resharing the excess until nobody is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = {}, budget * sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        rest, w = total - sum(full.values()), sum(weight[s] for s in free)
        share = {s: rest * weight[s] / w for s in free}
        over = [s for s in free if share[s] >= most * sizes[s]]
        if not over:
            return full | share
        full |= {s: float(most * sizes[s]) for s in over}


def rows(n=600):
    out = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else [None, "a", "b", "ä", "Z", "tiny"][i % 6 if i % 50 else 5]
        out.append((i, prose(5 + i * 7 % 60, i), "en", source, 0))
    return out


def test_targets_copies_and_draws(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = mixing.plan(df).collect()
    sizes = defaultdict(int)
    for r in data:
        sizes[r[3]] += len(WORD.findall(r[1]))
    want, taken, largest = filled(sizes), defaultdict(int), defaultdict(int)
    assert len(got) == len(data)
    for r in got:
        assert r.size == len(WORD.findall(r.text)) and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 and r.taken == r.copies * r.size <= 2 * r.size
        assert len(r.shards) == r.copies and all(0 <= s < 16 for s in r.shards)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.plan(df.repartition(5)).collect()))
    drawn = mixing.draw(mixing.plan(df)).collect()
    assert Counter(r.doc_id for r in drawn) == Counter({r.doc_id: r.copies for r in got if r.copies})
    assert Counter((r.doc_id, r.shard) for r in drawn) == Counter((r.doc_id, s) for r in got for s in r.shards)


def test_tree_keeps_quotas_and_sizes(spark):
    quotas = spark.createDataFrame([("a", 100), ("b", 7), ("c", 0), ("d", 33)], "s string, n long")
    got = mixing.split_tree(quotas, mixing.Mix(shards=8)).collect()
    by_source, by_shard = Counter(), Counter()
    for r in got:
        by_source[r.s] += r.n
        by_shard[r.shard] += r.n
    assert by_source == {"a": 100, "b": 7, "d": 33} and sum(by_shard.values()) == 140
    assert set(by_shard) == set(range(8)) and max(by_shard.values()) - min(by_shard.values()) <= 3


def test_splits_follow_the_hypergeometric_law(spark):
    """Blocks of one source in the first of two shards: mean nK/N, variance as without replacement."""
    quotas = spark.createDataFrame([("a", 12), ("b", 28)], "s string, n long").cache()
    left = []
    for seed in range(60):
        rows = mixing.split_tree(quotas, mixing.Mix(shards=2, seed=seed)).collect()
        left.append(sum(r.n for r in rows if r.s == "a" and r.shard == 0))
    mean = sum(left) / len(left)
    spread = sum((x - mean) ** 2 for x in left) / len(left)
    assert abs(mean - 6) < 0.7 and 1.0 < spread < 4.2  # 20 * .3 * .7 * 20 / 39 = 2.15


def test_awkward_rows(spark):
    df = spark.createDataFrame([(*r, 9) for r in awkward()], SCHEMA + ", Target int")
    got = mixing.plan(df).collect()
    assert len(got) == len(awkward()) and all(r.taken == 0 for r in got if not (r.text or "").split())
    empty = mixing.plan(df.where(F.lit(False)))
    assert empty.count() == 0 and mixing.draw(empty).count() == 0
    none = mixing.plan(df.where("doc_id in (1, 2)"))
    assert [r.target for r in none.collect()] == [0.0, 0.0]


def test_no_python_in_the_plan(spark):
    plan = mixing.plan(spark.createDataFrame(rows(30), SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
