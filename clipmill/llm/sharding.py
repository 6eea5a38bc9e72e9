"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Documents with equal texts share a place on the ring. Each shard owns many arcs (virtual nodes); a
document belongs to the first virtual node clockwise of its place, and when that shard is full it
continues clockwise to the next shard with room. The bound on a shard's bytes guarantees the balance,
and adding a shard moves little, because all other virtual nodes stay where they are.

At scale nothing walks the documents one by one. The ring is cut into 65,536 cells; one aggregate
gives each cell's rows and bytes, and the walk is done over the cells, whose number is fixed. A cell with
over four times the mean rows or bytes of a cell (one text copied very often) is also counted in parts of
about that mean, by a hash of the whole row; it stays whole if any shard has room for it, else its parts
go on clockwise one by one. Rows that are alike in every column cannot be told apart by a hash: where
they overfill a part they are counted as one row with a number of copies, which is cut into runs of
the mean and spread out again at the end. There are at most some 400,000 cells, parts and runs, whatever
the data. Slots follow from counts: a part's first slot is the sum of the parts before it on its shard,
so ranking happens inside parts only.

Defined results: a null text counts as an empty one (size 1). Null and repeated ids are placed like any
other. Repeated rows get slots of their own. A document larger than a shard's share goes to the emptiest
shard where no other has room. Clashing input columns are replaced. No rows, no shards used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipmill.llm.common import others, packed, quoted, text_of

CELL_BITS = 16
CELLS = 1 << CELL_BITS
#: A cell or part with so many times the mean load of a cell is split.
HEAVY = 4

ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


@dataclass(frozen=True)
class Ring:
    """``shards`` with ``vnodes`` places each; a shard takes at most (1 + slack) of the mean bytes."""

    shards: int = 16
    vnodes: int = 128
    slack: float = 1 / 2048
    seed: int = 0

    def clockwise(self) -> np.ndarray:
        """For each cell, the shards in the order a document meets them walking clockwise."""
        places = sorted(
            (xxhash.xxh64_intdigest(f"{shard}/{v}", self.seed) >> (64 - CELL_BITS), shard, v)
            for shard in range(self.shards)
            for v in range(self.vnodes)
        )
        owners = [shard for _, shard, _ in places]
        orders = np.empty((len(owners), self.shards), dtype=np.int32)
        for i in range(len(owners)):
            orders[i] = list(dict.fromkeys(owners[i:] + owners[:i]))
        first = np.searchsorted([p for p, _, _ in places], np.arange(CELLS)) % len(owners)
        return orders[first]


def _walk(ring: Ring, cells: dict[int, tuple[int, int]], parts: dict[int, dict[int, tuple[int, int]]]) -> list[tuple]:
    """(cell, part or -1, shard, first slot) from rows and bytes of cells and of heavy cells' parts.

    Larger loads walk first, so that small ones fill the gaps. A load that fits nowhere goes to the
    emptiest shard.
    """
    orders = ring.clockwise()
    room = [math.ceil(sum(b for _, b in cells.values()) / ring.shards * (1 + ring.slack))] * ring.shards

    def place(cell: int, load: int, must: bool) -> int:
        for shard in orders[cell]:
            if room[shard] >= load:
                room[shard] -= load
                return int(shard)
        if must:
            shard = max(range(ring.shards), key=lambda s: (room[s], -s))
            room[shard] -= load
            return shard
        return -1

    where: list[tuple[int, int, int, int]] = []  # cell, part, shard, rows
    for cell, (rows, load) in sorted(cells.items(), key=lambda x: (-x[1][1], x[0])):
        if cell not in parts:
            where.append((cell, -1, place(cell, load, True), rows))
            continue
        shard = place(cell, load, False)
        for part, (n, b) in sorted(parts[cell].items(), key=lambda x: (-x[1][1], x[0])):
            where.append((cell, part, place(cell, b, True) if shard < 0 else shard, n))
    placed, slots = [], [0] * ring.shards
    for cell, part, shard, rows in sorted(where):
        placed.append((cell, part, shard, slots[shard]))
        slots[shard] += rows
    return placed


@dataclass(frozen=True)
class _Mean:
    """Mean rows and bytes of a cell, at least one."""

    rows: float
    size: float

    def times(self, n: int, b: int) -> float:
        return max(n / self.rows, b / self.size)

    def heavy(self, n: int, b: int) -> bool:
        return n > 1 and self.times(n, b) > HEAVY

    def parts(self, n: int, b: int) -> int:
        """A power of two, so that parts hold about the mean."""
        return 1 << math.ceil(math.log2(min(n, self.times(n, b))))

    def run(self, size: int) -> int:
        """Copies of a row of this size in a run."""
        return max(1, int(min(self.rows, self.size / size)))


def _hashed(docs: DataFrame, names: list[str]) -> list[Column]:
    """The columns that can be hashed."""
    def plain(kind: T.DataType) -> bool:
        return not any(word in kind.simpleString() for word in ("map<", "variant"))

    return [F.col(quoted(f.name)) for f in docs.schema.fields if f.name in names and plain(f.dataType)]


def shard(docs: DataFrame, ring: Ring = Ring(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with size, text_crc32, law ('bytes'), shard, slot and grown_shard (null)."""
    spark = docs.sparkSession
    body = text_of(text)
    kept = others(docs, *ADDED)
    hashes = F.xxhash64(F.lit(ring.seed), F.col(quoted(doc_id)).cast("string"), *_hashed(docs, kept))
    keyed = docs.select(
        packed(docs, *ADDED).alias("row"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64(body).alias("h"),
        hashes.alias("d"),
    )
    keyed = keyed.withColumn("cell", F.shiftrightunsigned("h", 64 - CELL_BITS).cast("int"))
    load = [F.count("*").alias("n"), F.sum("size").alias("b")]
    narrow = keyed.select("cell", "d", "size")
    cells = {r.cell: (r.n, r.b) for r in narrow.groupBy("cell").agg(*load).collect()}  # at most CELLS rows
    mean = _Mean(*(max(1, sum(x) / CELLS) for x in (zip(*cells.values()) if cells else ((), ()))))
    split = [(c, mean.parts(n, b)) for c, (n, b) in cells.items() if mean.heavy(n, b)]
    parts: dict[int, dict[int, tuple[int, int]]] = {c: {} for c, _ in split}
    runs: list[tuple[int, int, int, int]] = []  # cell, d, number of the first part, copies in a run
    if split:
        divided = F.broadcast(spark.createDataFrame(split, "cell int, parts long"))  # at most CELLS
        part = F.coalesce(F.col("d").bitwiseAND(F.col("parts") - 1), F.lit(-1))
        keyed = keyed.join(divided, "cell", "left").withColumn("part", part).drop("parts")
        inside = narrow.join(divided, "cell").withColumn("part", part)
        full = []
        for r in inside.groupBy("cell", "part").agg(*load).collect():  # at most 4 * CELLS parts
            parts[r.cell][r.part] = (r.n, r.b)
            if mean.heavy(r.n, r.b):
                full.append((r.cell, r.part))
        if full:
            runs = _runs(inside.join(F.broadcast(spark.createDataFrame(full, "cell int, part long")), ["cell", "part"]), mean, parts)
    else:
        keyed = keyed.withColumn("part", F.lit(-1).cast("long"))
    placed = spark.createDataFrame(
        _walk(ring, cells, parts) or [(0, -1, 0, 0)], "cell int, part long, shard int, first long"
    )
    group = Window.partitionBy("cell", "part").orderBy("h", "d", "size")
    ranks = F.row_number().over(group).alias("rank")
    columns = ["row", "size", "text_crc32", "cell", "part"]
    if runs:
        known = F.broadcast(spark.createDataFrame(runs, "cell int, d long, base long, run long"))  # at most CELLS
        alike = _numbered(keyed.join(known, ["cell", "d"]))
        keyed = keyed.join(known, ["cell", "d"], "left_anti")
        ranked = keyed.select(*columns, ranks).unionByName(alike.select(*columns, "rank"))
    else:
        ranked = keyed.select(*columns, ranks)
    joined = ranked.join(F.broadcast(placed), ["cell", "part"])  # bounded: cells, parts and runs
    return joined.select(
        *[F.col("row")[c].alias(c) for c in kept],
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.col("rank") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _runs(rows: DataFrame, mean: _Mean, parts: dict[int, dict[int, tuple[int, int]]]) -> list[tuple[int, int, int, int]]:
    """The rows alike that overfill parts, as runs, which ``parts`` are given in their stead."""
    groups = rows.groupBy("cell", "part", "d", "size").agg(F.count("*").alias("n"))
    heavy = F.greatest(F.col("n") / mean.rows, F.col("n") * F.col("size") / mean.size) > HEAVY
    found = sorted(groups.where(heavy & (F.col("n") > 1)).collect())  # at most 2 * CELLS / HEAVY groups
    runs, base = [], max((p for c in parts.values() for p in c), default=0) + 1
    for r in found:
        of_cell, run = parts[r.cell], mean.run(r.size)
        n, b = of_cell[r.part]
        of_cell[r.part] = (n - r.n, b - r.n * r.size)
        for k in range(0, r.n, run):
            some = min(run, r.n - k)
            of_cell[base + k // run] = (some, some * r.size)
        runs.append((r.cell, r.d, base, run))
        base += -(-r.n // run)
    return runs


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows alike, counted and spread out again run by run, with ``part`` and ``rank`` of each copy."""
    key = ["row", "size", "text_crc32", "cell", "d", "base", "run"]
    groups = rows.groupBy(*key).agg(F.count("*").alias("n"))
    # One group for each hash, unless columns that cannot be hashed differ: these follow one another.
    before = Window.partitionBy("cell", "d").orderBy("n", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    end = F.col("start") + F.col("n") - 1
    numbers = F.sequence(F.floor(F.col("start") / F.col("run")), F.floor(end / F.col("run")))
    spread = groups.select("*", F.explode(numbers).alias("k")).repartition("cell", "k")
    first = F.greatest("start", F.col("k") * F.col("run"))
    last = F.least(end, (F.col("k") + 1) * F.col("run") - 1)
    copies = spread.select("*", F.explode(F.sequence(first, last)).alias("copy"))
    return copies.withColumn("part", F.col("base") + F.col("k")).withColumn("rank", F.col("copy") - F.col("k") * F.col("run") + 1)
