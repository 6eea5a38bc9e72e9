"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Weights fix how many words each source gives (a source gives at most `Mix.most` times its own); whole
passes over the source and one partial pass, cut within half a document of the quota, give every
document its number of copies. A pass lays the source out in blocks by hash, which is a random
permutation; the blocks drawn of each source are its exact quota.

Quotas are then split among the output shards by a tree: a node's blocks are divided between its two
halves as drawing without replacement would (the multivariate hypergeometric law, drawn block by block
with the chance the remaining places give), down to the shards. Each shard draws its share of every
source's permuted blocks, so blocks are disjoint, and its rows are shuffled inside the shard.

All of it is built-in functions. Documents are read twice and never ranked: the cut of the partial
pass is found from sums over 4,096 blocks, then over 4,096 parts of the one block it falls in, then
over the rows of one part. The tree works on one row per source and node.

Defined results: a null text has no words, is copied like its neighbours and takes nothing. Null
sources are one source, the last. A source without words has target 0. Repeated rows stand together,
before or after a cut. Clashing input columns are replaced. No rows, no shards. Runs with one seed agree.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipmill.llm.common import cut, others, packed, partitions_for, quoted, text_of, words_of

ADDED = ("size", "source_size", "target", "taken", "copies", "shards")
_DIGIT = 12
#: Rows of a table that may be sent to every task (under 60 bytes each).
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Mix:
    """Sources in code point order take ``weights`` in turn and share ``budget`` times all words."""

    weights: tuple[int, ...] = (3, 1, 2)
    budget: float = 1.5
    most: int = 2
    shards: int = 16
    seed: int = 5

    def __post_init__(self) -> None:
        if self.shards & (self.shards - 1) or self.shards < 1:
            raise ValueError("shards must be a power of two")


def _keyed(docs: DataFrame, mix: Mix, text: str, source: str, doc_id: str) -> DataFrame:
    """Each row with its words, source key (s, never null) and place (b1, b2, h) in the permutation."""
    body, name, row_id = text_of(text), F.col(quoted(source)).cast("string"), F.col(quoted(doc_id)).cast("string")
    keyed = docs.select(
        packed(docs, *ADDED).alias("row"),
        F.size(words_of(body)).cast("long").alias("size"),
        name.alias("source"),
        F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("s"),
        F.xxhash64(F.lit(mix.seed), row_id, body).alias("h"),
        F.coalesce(row_id, F.lit("")).alias("id"),
    )
    digit = lambda k: F.shiftrightunsigned("h", 64 - k * _DIGIT).bitwiseAND((1 << _DIGIT) - 1).cast("int")
    return keyed.select("*", digit(1).alias("b1"), digit(2).alias("b2"))


def _small(df: DataFrame) -> DataFrame:
    """``df``, to be sent to every task if its rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def targets(blocks: DataFrame, mix: Mix) -> DataFrame:
    """(s, source_size, target, passes, quota) by source, from (s, source, words).

    ``target`` fills up by weight to ``most`` times the source: in order of the room for each unit of
    weight, a source is full if the level of all that follow would reach its room. ``passes`` whole
    passes and ``quota`` words of one more give the target.
    """
    sizes = blocks.groupBy("s", "source").agg(F.sum("words").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")  # one row per source
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(mix.weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), turn + 1)
    rows = sizes.select("*", weight.alias("w"), (F.col("source_size") * mix.most).alias("room"))
    by_room = Window.orderBy(F.col("room") / F.col("w"), F.col("source").isNull(), "source")
    total = Window.partitionBy()
    before = F.coalesce(F.sum("room").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("w").over(by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.select("*", (mix.budget * F.sum("source_size").over(total)).alias("all"), before.alias("before"), after.alias("after"))
    full = F.col("room") / F.col("w") <= (F.col("all") - F.col("before")) / F.col("after")
    rows = rows.select("*", full.alias("full"))
    rest = F.col("all") - F.coalesce(F.sum(F.when(F.col("full"), F.col("room"))).over(total), F.lit(0))
    level = rest / F.sum(F.when(~F.col("full"), F.col("w"))).over(total)
    rows = rows.select("*", F.when(F.col("full"), F.col("room").cast("double")).otherwise(F.col("w") * level).alias("target"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    rows = rows.select("s", "source", "source_size", "target", passes.alias("passes"))
    return rows.select("*", (F.col("target") - F.col("passes") * F.col("source_size")).alias("quota"))


def _crossing(sums: DataFrame, quota: DataFrame, at: str) -> DataFrame:
    """(s, at, left): the part ``at`` in which the running sum of a source passes its quota, and what is left of it."""
    running = Window.partitionBy("s").orderBy(at)
    rows = sums.join(_small(quota), "s").select("s", at, "words", "quota", (F.sum("words").over(running) - F.col("words")).alias("before"))
    reached = rows.where(F.col("before") + F.col("words") > F.col("quota"))
    first = reached.groupBy("s").agg(F.min(F.struct(at, "before", "quota")).alias("x"))
    return first.select("s", F.col("x")[at].alias(at), (F.col("x.quota") - F.col("x.before")).alias("left"))


def _cuts(keyed: DataFrame, blocks: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source the cut of its partial pass: block c1, part c2 and the last row (last) inside."""
    quota = sources.where("quota > 0").select("s", "quota")
    one = cut(_crossing(blocks, quota, "b1"))
    inside = keyed.select("s", "b1", "b2", "h", "id", "size").join(_small(one), ["s", "b1"])
    parts = inside.groupBy("s", "b2").agg(F.sum("size").alias("words"))
    two = cut(_crossing(parts, one.select("s", F.col("left").alias("quota")), "b2"))
    rows = inside.drop("left").join(_small(two), ["s", "b2"])
    running = Window.partitionBy("s").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = rows.select("s", "h", "id", "left", "size", F.sum("size").over(running).alias("sum"))
    taken = taken.where(F.col("sum") - F.col("size") / 2 <= F.col("left"))
    last = taken.groupBy("s").agg(F.max(F.struct("h", "id")).alias("last"))
    cuts = one.select("s", F.col("b1").alias("c1")).join(two.select("s", F.col("b2").alias("c2")), "s", "left")
    return cuts.join(last, "s", "left")


def _extra() -> Column:
    """Whether a row lies before its source's cut."""
    place, cut_place = F.struct("b1", "b2"), F.struct(F.col("c1").alias("b1"), F.col("c2").alias("b2"))
    at = (place == cut_place) & F.coalesce(F.struct("h", "id") <= F.col("last"), F.lit(False))
    return F.coalesce((place < cut_place) | at, F.lit(False))


def split_tree(quotas: DataFrame, mix: Mix) -> DataFrame:
    """(shard, s, n): every source's blocks (s, n) divided among the shards by the tree."""

    def uniform(node: Column, s: Column, i: Column) -> Column:
        return (F.shiftrightunsigned(F.xxhash64(F.lit(mix.seed), node, s, i), 11) + 0.5) / float(1 << 53)

    def block(node: Column, s: Column):
        def step(a: Column, i: Column) -> Column:
            left = F.when(uniform(node, s, i) * a["pop"] < a["draw"], F.lit(1)).otherwise(F.lit(0)).cast("long")
            return F.struct((a["pop"] - 1).alias("pop"), (a["draw"] - left).alias("draw"), (a["x"] + left).alias("x"))

        return step

    def divide(node: Column):
        def source(state: Column, q: Column) -> Column:
            start = F.struct(state["pop"].alias("pop"), state["draw"].alias("draw"), F.lit(0).cast("long").alias("x"))
            end = F.aggregate(F.sequence(F.lit(1).cast("long"), q["n"]), start, block(node, q["s"]))
            done = F.transform(
                F.array(end),
                lambda e: F.struct(
                    e["pop"].alias("pop"),
                    e["draw"].alias("draw"),
                    F.concat(state["out"], F.array(F.struct(q["s"].alias("s"), q["n"].alias("n"), e["x"].alias("x")))).alias("out"),
                ),
            )
            return F.get(done, 0)

        return source

    rows = quotas.where("n > 0").select(F.lit(1).cast("long").alias("node"), "s", "n")
    for _ in range(int(math.log2(mix.shards))):
        nodes = rows.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("s", "n"))).alias("q"), F.sum("n").alias("pop"))
        empty = F.array().cast("array<struct<s:string,n:bigint,x:bigint>>")
        start = F.struct("pop", F.expr("pop div 2").alias("draw"), empty.alias("out"))
        split = nodes.select("node", F.aggregate("q", start, divide(F.col("node")), lambda a: a["out"]).alias("out"))
        split = split.select("node", F.inline("out"))
        halves = F.array(
            F.struct((2 * F.col("node")).alias("node"), F.col("x").alias("n")),
            F.struct((2 * F.col("node") + 1).alias("node"), (F.col("n") - F.col("x")).alias("n")),
        )
        rows = cut(split.select("s", F.inline(halves)).where("n > 0").select("node", "s", "n"))
    return rows.select((F.col("node") - mix.shards).cast("int").alias("shard"), "s", "n")


def _shards(blocks: DataFrame, cuts: DataFrame, mix: Mix) -> DataFrame:
    """(s, b1, by_pass): the shard of each block in every pass that draws it."""
    last = F.col("passes") + F.when(F.col("quota") > 0, F.coalesce((F.col("b1") <= F.col("c1")).cast("int"), F.lit(0))).otherwise(0)
    drawn = blocks.join(cuts, "s").select("s", "b1", last.alias("k")).where("k > 0")
    drawn = drawn.select("s", "b1", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("pass"))
    order = Window.partitionBy("s").orderBy(F.xxhash64(F.lit(mix.seed + 1), "s", "pass", "b1"), "pass", "b1")
    ranked = cut(drawn.select("s", "b1", "pass", F.row_number().over(order).cast("long").alias("rank")))
    shares = split_tree(ranked.groupBy("s").agg(F.count("*").alias("n")), mix)
    ends = Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = shares.select("s", "shard", "n", F.sum("n").over(ends).alias("end"))
    ranks = ranges.select("s", "shard", F.explode(F.sequence(F.col("end") - F.col("n") + 1, "end")).alias("rank"))
    placed = ranked.join(ranks, ["s", "rank"]).groupBy("s", "b1")
    passes = placed.agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("p"))  # one a pass
    return passes.select("s", "b1", F.transform("p", lambda x: x["shard"]).alias("by_pass"))


def plan(docs: DataFrame, mix: Mix = Mix(), text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with size, source_size, target, taken, copies, and the shards of its copies."""
    keyed = _keyed(docs, mix, text, source, doc_id)
    narrow = cut(keyed.drop("row"))
    blocks = cut(narrow.groupBy("s", "source", "b1").agg(F.sum("size").alias("words")))
    sources = cut(targets(blocks, mix))
    cuts = cut(sources.join(_cuts(narrow, blocks, sources), "s", "left"))
    shards = cut(_shards(blocks.drop("source"), cuts.drop("source"), mix))
    rows = keyed.drop("source").join(_small(cuts.drop("source")), "s").join(_small(shards), ["s", "b1"], "left")
    copies = F.col("passes") + _extra().cast("int")
    rows = rows.select("*", copies.alias("copies"))
    return rows.select(
        *[F.col("row")[c].alias(c) for c in others(docs, *ADDED)],
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "copies",
        F.when(F.col("copies") > 0, F.slice("by_pass", F.lit(1), F.col("copies")))
        .otherwise(F.array().cast("array<int>"))
        .alias("shards"),
    )


def draw(planned: DataFrame, mix: Mix = Mix(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The mixture: a row per copy with its ``shard``, shards together and shuffled inside.

    Rows are dealt by shard and a digit of their random order, so that a shard spans several tasks.
    """
    copies = planned.select("*", F.posexplode("shards").alias("_pass", "shard")).drop("shards")
    order = F.xxhash64(F.lit(mix.seed + 2), F.col(quoted(doc_id)).cast("string"), text_of(text), "_pass")
    spread = max(1, partitions_for(planned.sparkSession) // mix.shards)
    dealt = copies.withColumn("_order", order).repartition(F.col("shard"), F.pmod("_order", F.lit(spread)))
    return dealt.sortWithinPartitions("shard", "_order").drop("_order", "_pass")
