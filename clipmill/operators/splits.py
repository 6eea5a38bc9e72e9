"""Seeded train/validation/test assignment.

A row's split follows from the MD5 of seed and key alone. That is public and the same in every
engine, needs no shuffle, and does not change with partitioning, retries or added rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipmill.schemas import SPLITS
from clipmill.spec import SplitPolicy, check_ratios

# Column whose value decides a row's split, per kind.
SPLIT_KEYS = {"random": "id", "by_source_file": "file_id", "by_labeller": "created_by"}

# Buckets of the exact cut: four hex digits of the hash, at most 65,536 groups.
_BUCKET_DIGITS = 4


def key_hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on seed and key only."""
    return F.conv(F.substring(key_hash(key, seed), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def split_limits(ratios, reserved: bool = False) -> list[tuple[str, float]]:
    """Splits that get rows, with their upper limits; the last one takes the remainder."""
    open_splits = SPLITS[:2] if reserved else SPLITS
    limits, upper = [], 0.0
    for split, ratio in zip(open_splits, ratios):
        upper += ratio
        if ratio > 0:
            limits.append((split, upper))
    return limits


def _ladder(limits: list[tuple[str, object]], below) -> Column:
    """First split whose limit the row is below; the last split has none."""
    *cuts, (last, _) = limits
    choice = F.lit(last)
    for split, limit in reversed(cuts):
        choice = F.when(below(limit), F.lit(split)).otherwise(choice)
    return choice


def assign_split(
    df: DataFrame,
    policy: SplitPolicy = SplitPolicy(),
    use_reserved: bool | None = None,
    exact: bool = False,
) -> DataFrame:
    """Add ``split``.

    With ``use_reserved`` the rows of reserved files (column ``reserved``) are the whole test
    split and the others are shared by the first two ratios; otherwise reservation is ignored.
    ``exact`` hits the quotas to the row, for kind ``random`` only.
    """
    reserved = use_reserved is True
    check_ratios(tuple(policy.ratios), reserved)
    limits = split_limits(policy.ratios, reserved)
    if exact:
        if policy.kind != "random":
            raise ValueError(f"exact quotas are for kind 'random', not {policy.kind!r}")
        drawn = _exact_choice(df.where(~F.col("reserved")) if reserved else df, policy.seed, limits)
    else:
        u = uniform(F.col(SPLIT_KEYS[policy.kind]), policy.seed)
        drawn = _ladder(limits, lambda limit: u < F.lit(limit))
    if reserved:
        drawn = F.when(F.col("reserved"), F.lit("test")).otherwise(drawn)
    return df.withColumn("split", drawn)


def _exact_choice(df: DataFrame, seed: int, limits: list[tuple[str, float]]) -> Column:
    """Exact quotas without a global sort.

    Rows are ranked by (hash, key). Only the rank cuts matter, so the rows are counted per hash
    bucket, the bucket of each cut is found from the running counts, and only those buckets (about
    one row in 65,536 each) are looked at closely. The cuts come back as scalar subqueries, so the
    full table itself is assigned by comparison, without a shuffle.
    """
    token = F.concat(key_hash(F.col("id"), seed), F.col("id").cast("string"))
    tokens = df.select(token.alias("token")).withColumn("bucket", F.left("token", F.lit(_BUCKET_DIGITS)))
    shares = [share for _, share in limits[:-1]]
    if not shares:
        return F.lit(limits[-1][0])

    # At most 65,536 rows from here to the cuts, so one task for the running count is fine.
    running = (
        tokens.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(Window.orderBy("bucket")))
        .withColumn("total", F.sum("n").over(Window.partitionBy()))
    )
    ranks = F.array(
        *[
            F.struct(F.lit(i).alias("cut"), F.floor(F.col("total") * F.lit(share)).cast("bigint").alias("rank"))
            for i, share in enumerate(shares)
        ]
    )
    cuts = (
        running.select("bucket", "n", "upto", F.inline(ranks))
        .where((F.col("rank") > F.col("upto") - F.col("n")) & (F.col("rank") <= F.col("upto")))
        .select("bucket", "cut", (F.col("rank") - F.col("upto") + F.col("n")).alias("place"))
    )
    # One row per distinct key, so repeated keys cannot swell a bucket.
    order = Window.partitionBy("cut").orderBy("token").rowsBetween(Window.unboundedPreceding, 0)
    edges = (
        tokens.join(F.broadcast(cuts), "bucket")  # one row per cut, two at most
        .groupBy("cut", "place", "token")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(order))
        .where(F.col("upto") >= F.col("place"))
    )
    # A quota of 0 rows has no edge: every token is above the empty text. One subquery for all cuts.
    firsts = [
        F.coalesce(F.min(F.when(F.col("cut") == i, F.col("token"))), F.lit("")).alias(split)
        for i, (split, _) in enumerate(limits[:-1])
    ]
    found = edges.agg(*firsts).select(F.struct(*[split for split, _ in limits[:-1]])).scalar()
    return _ladder([(split, found.getField(split)) for split, _ in limits[:-1]] + limits[-1:], lambda edge: token <= edge)
