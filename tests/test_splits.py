import hashlib
import math

import pytest
from pyspark.sql import functions as F

from clipmill import SplitPolicy
from clipmill.operators.splits import assign_split


def draw(seed, key):
    return int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:8], 16) / 2**32


def expected(u, ratios):
    return "train" if u < ratios[0] else "validation" if u < ratios[0] + ratios[1] else "test"


@pytest.fixture(scope="module")
def rows(spark):
    # One file holds a third of the rows.
    hot = F.when(F.col("id") % 3 == 0, F.lit("f0")).otherwise(F.concat(F.lit("f"), F.col("id") % 41))
    return spark.range(2000).select(
        F.col("id").cast("string").alias("id"),
        hot.alias("file_id"),
        (F.col("id") % 9).alias("created_by"),
        (F.col("id") % 5 == 0).alias("reserved"),
    )


def splits_of(df):
    return {r.id: r.split for r in df.select("id", "split").collect()}


@pytest.mark.parametrize("kind, key", [("random", "id"), ("by_source_file", "file_id"), ("by_labeller", "created_by")])
def test_split_follows_from_seed_and_key(rows, kind, key):
    policy = SplitPolicy(kind, 7, (0.6, 0.3, 0.1))
    got = assign_split(rows, policy).collect()
    assert all(r.split == expected(draw(7, r[key]), policy.ratios) for r in got)
    by_key = {}
    for r in got:
        by_key.setdefault(r[key], set()).add(r.split)
    assert all(len(found) == 1 for found in by_key.values())


@pytest.mark.parametrize("exact", [False, True])
def test_partitioning_does_not_matter(rows, exact):
    results = [splits_of(assign_split(rows.repartition(n), exact=exact)) for n in (1, 3, 17)]
    assert results[0] == results[1] == results[2]


def test_seed_matters(rows):
    assert splits_of(assign_split(rows, SplitPolicy(seed=1))) != splits_of(assign_split(rows, SplitPolicy(seed=2)))


def test_split_needs_no_shuffle(rows):
    df = assign_split(rows, SplitPolicy("by_source_file"))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("ratios", [(0.8, 0.1, 0.1), (0.5, 0.5, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0), (0.0, 0.7, 0.3)])
def test_exact_quotas(rows, ratios):
    got = splits_of(assign_split(rows, SplitPolicy("random", 42, ratios), exact=True))
    ranked = sorted(got, key=lambda k: (hashlib.md5(f"42:{k}".encode()).hexdigest(), k))
    n, cuts = len(ranked), (math.floor(len(ranked) * ratios[0]), math.floor(len(ranked) * (ratios[0] + ratios[1])))
    if ratios[2] == 0:
        cuts = (cuts[0] if ratios[1] else n, n)
    want = {k: "train" if i < cuts[0] else "validation" if i < cuts[1] else "test" for i, k in enumerate(ranked)}
    assert got == want


def test_exact_on_few_or_no_rows(rows):
    assert splits_of(assign_split(rows.limit(0), exact=True)) == {}
    assert set(splits_of(assign_split(rows.limit(1), exact=True)).values()) == {"test"}


def test_exact_with_repeated_keys_keeps_them_together(rows):
    doubled = rows.union(rows)
    found = assign_split(doubled, exact=True).groupBy("id").agg(F.countDistinct("split").alias("n"))
    assert found.agg(F.max("n")).head()[0] == 1


def test_exact_is_for_random_only(rows):
    with pytest.raises(ValueError, match="by_labeller"):
        assign_split(rows, SplitPolicy("by_labeller"), exact=True)


@pytest.mark.parametrize("exact", [False, True])
def test_reserved_files_are_the_test_split(rows, exact):
    df = assign_split(rows, SplitPolicy("random", 42, (0.9, 0.1, 0.0)), use_reserved=True, exact=exact)
    got = df.groupBy("split", "reserved").count().collect()
    counts = {(r.split, r.reserved): r["count"] for r in got}
    assert counts[("test", True)] == 400 and ("test", False) not in counts
    if exact:
        assert counts == {("test", True): 400, ("train", False): 1440, ("validation", False): 160}


@pytest.mark.parametrize("use_reserved", [None, False])
def test_reservation_off_is_ignored(rows, use_reserved):
    assert splits_of(assign_split(rows, use_reserved=use_reserved)) == splits_of(assign_split(rows.drop("reserved")))


def test_rounded_ratios_leave_no_gap(spark):
    # The ratios sum to a little less than 1; the highest draws must not fall into the test split.
    df = spark.range(20000).select(F.col("id").cast("string").alias("id"), F.lit(False).alias("reserved"))
    policy = SplitPolicy("random", 42, (0.5, 0.4999995, 0.0))
    for use_reserved in (True, None):
        found = assign_split(df, policy, use_reserved=use_reserved).select("split").distinct().collect()
        assert {r.split for r in found} == {"train", "validation"}
