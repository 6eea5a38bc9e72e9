"""Near-duplicate groups by MinHash with tensored banding.

Two small collections of MinHash tuples stand for one large one: `tables` tuples of `rows` hashes on
each side, and the key of table (i, j) is the pair of tuple i of the first side with tuple j of the
second. 12 x 12 tables of 8 rows each come from 96 MinHashes instead of 1,152. Two sets of Jaccard
similarity s meet in some table with probability (1 - (1 - s^4)^12)^2: over 0.9997 at 0.85.

1. Each text becomes its set of word shingles; equal sets are one node from here on, so exact copies
   of any number cost one row in an aggregate. A node keeps its tuples' keys and a sketch, one byte of
   each MinHash.
2. Nodes that share a tuple of the first side meet in a task, which pairs it with their tuples of the
   second side: nodes that agree on both share a table key. Of these pairs, those whose sketches differ
   too much for a link at the bound are left out (a link is lost with a probability under `MISSED`).
   A task sends no pairs but the groups that they connect, one row a node; clusters are the components
   of these rows over all tasks.
3. The sets of a cluster meet in a task, which counts all their intersections exactly, on all 64 bits of
   each shingle, and again sends the groups that links connect. Components of these are the result.

A bucket or cluster with more members than fit into one task is cut into blocks, and each pair of blocks
meets in a task of its own, so tasks are bounded, every pair is looked at, and no partner is dropped. Rows
between tasks grow with members times blocks; for a cluster of c different texts that is c * c / `SETS`.

Defined results: a null or empty text has an empty set (n_shingles 0) and is linked with nothing, its
component is itself. Rows with equal texts are linked whatever their ids; repeated rows get equal
results. A row without an id takes its group's smallest id, null if the group has none. Long texts are
taken whole; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmill import storage
from clipmill.llm import shingles
from clipmill.llm.common import MERGE, cut, quoted
from clipmill.llm.components import components
from clipmill.shipping import ship

#: Nodes of a bucket, and sets of a cluster, in one block; two blocks meet in a task.
NODES, SETS = 1_024, 256
#: Probability that a link is lost by its sketches.
MISSED = 1e-5
#: Rows that may be sent to every task (under 60 bytes each); beyond, the same joins shuffle.
BROADCAST_ROWS = 200_000
#: Pairs of sketches compared at a time, and shingles of a cluster.
_PAIRS, _SHINGLES = 1 << 14, 1 << 13


@dataclass(frozen=True)
class Banding:
    """``tables`` tuples of ``rows`` MinHashes on each of two sides; links from ``percent`` on."""

    rows: int = 4
    tables: int = 12
    shingle: int = 5
    percent: int = 85
    seed: int = 7

    def signatures(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of each (non-empty) set the 2 x ``tables`` half keys, first side first, and a byte of each MinHash."""
        values = np.concatenate(sets)
        first = np.concatenate(([0], np.cumsum([len(s) for s in sets[:-1]]))).astype(np.int64)
        seeds = np.random.default_rng(self.seed).integers(1, 2**63, (2 * self.tables, self.rows, 2), dtype=np.uint64)
        keys = np.empty((len(sets), 2 * self.tables), dtype=np.uint64)
        sketch = np.empty((len(sets), 2 * self.tables, self.rows), dtype=np.uint8)
        for t in range(2 * self.tables):
            key = np.full(len(sets), t + 1, dtype=np.uint64)
            for r, (flip, factor) in enumerate(seeds[t]):
                least = np.minimum.reduceat((values ^ flip) * (factor | np.uint64(1)), first)
                key = shingles.mixed(key ^ least)
                sketch[:, t, r] = least & np.uint64(255)
            keys[:, t] = key
        return keys.view(np.int64), sketch.reshape(len(sets), -1)

    @property
    def least_equal(self) -> int:
        """Equal bytes that the sketches of a link at the bound have, but for a probability of `MISSED`."""
        n, p, below = 2 * self.tables * self.rows, self.percent / 100, 0.0
        for k in range(n + 1):
            below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
            if below > MISSED:
                return k
        return n


def _node(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _signatures(docs: DataFrame, banding: Banding) -> DataFrame:
    """(id, n, node, halves, sketch) of each row of ``docs`` (id, text); the last three null when n is 0."""
    schema = pa.schema(
        [("id", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("halves", pa.list_(pa.int64())), ("sketch", pa.binary())]
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for part, texts in shingles.chunks(batch.column(1).to_pylist()):
                sets = shingles.shingle_sets(texts, banding.shingle)
                full = [i for i, s in enumerate(sets) if len(s)]
                nodes, halves, sketches = ([None] * len(sets) for _ in range(3))
                if full:
                    for i, keys, sketch in zip(full, *banding.signatures([sets[i] for i in full])):
                        nodes[i], halves[i], sketches[i] = _node(sets[i]), keys, sketch.tobytes()
                columns = [[len(s) for s in sets], nodes, halves, sketches]
                columns = [pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:])]
                yield pa.RecordBatch.from_arrays([ids.slice(part.start, len(sets)), *columns], schema=schema)

    return docs.mapInArrow(sign, "id long, n long, node binary, halves array<bigint>, sketch binary")


def _sets(docs: DataFrame, banding: Banding) -> DataFrame:
    """(node, set) of each row with a non-empty set; sets are sorted 64-bit shingles."""
    schema = pa.schema([("node", pa.binary()), ("set", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in shingles.chunks(batch.column(0).to_pylist()):
                sets = [s for s in shingles.shingle_sets(texts, banding.shingle) if len(s)]
                columns = [[_node(s) for s in sets], [s.tobytes() for s in sets]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return docs.select("text").mapInArrow(build, "node binary, set binary")


def _small(df: DataFrame) -> DataFrame:
    """``df``, to be sent to every task if it is known to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def labels_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of 0 to n - 1 that each can reach over links (a, b)."""
    labels = np.arange(n)
    while True:
        low = np.minimum(labels[a], labels[b])
        after = labels.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == labels).all():
            return labels
        labels = after


def _met(rows: DataFrame, group: str, size: Column, most: int, connect: Callable) -> DataFrame:
    """(a, b) connecting the rows (node, ...) of each group as ``connect`` finds.

    Groups of more than ``most`` rows are cut into blocks by a hash of the node, and all pairs of blocks
    meet. ``connect(columns, groups)`` gets the rows of whole groups, sorted, with a number for each
    group, and returns a label for each row: rows of one label are connected.
    """
    blocks = F.ceil(size / most).cast("int")
    own = F.pmod(F.xxhash64("node", group), blocks).cast("int")
    cut_up = rows.withColumns({"blocks": blocks, "own": own})
    cut_up = cut_up.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = [F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")]
    keep = [c for c in rows.columns if c != group]
    # Sorted by node too, so that groups of much the same nodes name the same, least one for all of them.
    met = cut_up.select(group, *pair, *keep).repartition(group, "lo", "hi").sortWithinPartitions(group, "lo", "hi", "node")
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def connected(table: pa.Table, groups: np.ndarray) -> Iterator[pa.RecordBatch]:
            if table.num_rows:
                table = table.combine_chunks()
                labels = connect(table, groups)
                moved = np.flatnonzero(labels != np.arange(len(labels)))
                nodes = table.column("node").combine_chunks()
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(x)).cast(pa.binary()) for x in (moved, labels[moved])], schema=schema)

        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None or not held.num_rows else pa.concat_tables([held, rows])
            groups = _numbered(held)
            whole = int(np.searchsorted(groups, groups[-1])) if len(groups) else 0  # the last group may go on
            if whole:
                yield from connected(held.slice(0, whole), groups[:whole])
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from connected(held, _numbered(held))

    return met.mapInArrow(run, "a binary, b binary")


def _numbered(table: pa.Table) -> np.ndarray:
    """A number for each run of rows with equal first three columns."""
    change = np.zeros(table.num_rows, dtype=bool)
    for k in range(3):
        column = table.column(k).combine_chunks()
        if pa.types.is_binary(column.type):
            values = np.array(column.to_pylist(), dtype=object)
        else:
            values = column.to_numpy(zero_copy_only=False)
        change[1:] |= values[1:] != values[:-1]
    return np.cumsum(change)


def _fixed(table: pa.Table, name: str, kind: str) -> np.ndarray:
    """A column of equally long lists or bytes as a matrix."""
    column = table.column(name).combine_chunks()
    if pa.types.is_binary(column.type):
        values = np.frombuffer(b"".join(column.to_pylist()), dtype=kind)
    else:
        values = column.flatten().to_numpy()
    return values.reshape(table.num_rows, -1)


def _meeting(banding: Banding) -> Callable:
    """Connects nodes of a first-side tuple that share a tuple of the second side and have similar sketches."""
    percent, least = banding.percent, banding.least_equal

    def connect(table: pa.Table, groups: np.ndarray) -> np.ndarray:
        n = table.column("n").to_numpy()
        tuples, sketch = _fixed(table, "y", "<i8"), _fixed(table, "sketch", "u1")
        last = np.searchsorted(groups, groups, "right")
        rows, found = np.arange(len(groups)), []
        step = 0
        while True:
            step += 1
            rows = rows[rows + step < last[rows]]  # row i meets i + step, while that is of its group
            if not len(rows):
                break
            for k in range(0, len(rows), _PAIRS):
                a = rows[k : k + _PAIRS]
                near = 100 * np.minimum(n[a], n[a + step]) >= percent * np.maximum(n[a], n[a + step])
                a = a[near]
                a = a[(sketch[a] == sketch[a + step]).sum(axis=1) >= least]
                a = a[(tuples[a] == tuples[a + step]).any(axis=1)]
                if len(a):
                    found.append((a, a + step))
        if not found:
            return np.arange(len(groups))
        return labels_of(len(groups), *(np.concatenate(x) for x in zip(*found)))

    return connect


def linked(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of sets that are links, by exact intersections of all."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    _, number, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times > 1
    column = (np.cumsum(shared) - 1)[number]
    keep = shared[number]
    owner, column = owner[keep], column[keep]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    same = np.zeros((n, n), dtype=np.int64)
    for start in range(0, int(shared.sum()), _SHINGLES):
        a, b = np.searchsorted(column, (start, start + _SHINGLES))
        bits = np.zeros((n, _SHINGLES), dtype=bool)
        bits[owner[a:b], column[a:b] - start] = True
        words = np.packbits(bits, axis=1).view(np.uint64)
        words = words[:, words.any(axis=0)]
        for i in range(n - 1):
            same[i, i + 1 :] += np.bitwise_count(words[i] & words[i + 1 :]).sum(axis=1, dtype=np.int64)
    both = sizes[:, None] + sizes[None]
    return np.nonzero((same > 0) & (100 * same >= percent * (both - same)))


def _confirming(banding: Banding) -> Callable:
    """Connects nodes of a cluster whose full sets are links."""
    percent = banding.percent

    def connect(table: pa.Table, groups: np.ndarray) -> np.ndarray:
        sets = [np.frombuffer(x, dtype="<u8") for x in table.column("set").to_pylist()]
        labels = np.arange(len(groups))
        borders = np.concatenate(([0], np.flatnonzero(np.diff(groups)) + 1, [len(groups)])).tolist()
        for a, b in zip(borders[:-1], borders[1:]):
            if b - a > 1:
                labels[a:b] = a + labels_of(b - a, *linked(sets[a:b], percent))
        return labels

    return connect


def _clusters(nodes: DataFrame, banding: Banding) -> DataFrame | None:
    """(a, b) connecting nodes that share a table key and have similar sketches."""
    x, y = F.slice("halves", 1, banding.tables), F.slice("halves", banding.tables + 1, banding.tables)
    halves = nodes.select("node", F.explode(x).alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("c")).where("c > 1")
    near = halves.join(shared, "half").groupBy("node").agg(F.collect_list(F.struct("half", "c")).alias("met"))  # <= tables each
    rows = near.join(nodes.select("node", "n", y.alias("y"), "sketch"), "node")
    rows = rows.select("node", "n", "y", "sketch", F.explode("met").alias("met"))
    rows = rows.select(F.col("met.half").alias("half"), "node", "n", "y", "sketch", F.col("met.c").alias("c"))
    return _met(rows, "half", F.col("c"), NODES, _meeting(banding))


def _links(docs: DataFrame, nodes: DataFrame, clusters: DataFrame, banding: Banding) -> DataFrame:
    """(a, b) connecting nodes that links connect, from the full sets of each cluster.

    Texts of the nodes in clusters become sets where they are read; each set goes to its cluster.
    """
    sizes = clusters.groupBy("comp").agg(F.count("*").alias("c"))
    members = cut(clusters.join(sizes, "comp").join(nodes.select("node", "rep"), "node"))
    wanted = _small(cut(members.select("rep").distinct()))
    texts = docs.join(wanted, docs.id.eqNullSafe(F.col("rep")), "left_semi")
    sets = _sets(texts, banding).join(_small(members.select("node", "comp", "c")), "node").dropDuplicates(["node"])
    return _met(sets.select("comp", "node", "set", "c"), "comp", F.col("c"), SETS, _confirming(banding))


def link_components(docs: DataFrame, banding: Banding = Banding(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``; ids are integers."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(quoted(doc_id)).cast("long").alias("id"), F.col(quoted(text)).cast("string").alias("text"))
    with storage.staged(_signatures(docs, banding), "signatures") as signed:
        first = lambda c: F.first(c).alias(c)
        nodes = signed.where("n > 0").groupBy("node").agg(F.min("id").alias("rep"), F.max("n").alias("n"), first("halves"), first("sketch"))
        with storage.staged(nodes, "nodes") as nodes:
            comps = components(_clusters(nodes, banding))
            comps = components(_links(docs, nodes, comps, banding))
            joined = nodes.select("node", "rep").join(comps, "node")
            least = joined.groupBy("comp").agg(F.min("rep").alias("least"))
            joined = joined.join(least, "comp").select("node", "least")
            found = nodes.select("node", "rep").join(joined.hint(MERGE), "node", "left")
            found = found.select("node", F.coalesce("least", "rep").alias("rep"))
            component = F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("id"))
            return cut(
                signed.select("id", "n", "node").join(found, "node", "left").select(
                    F.col("id").alias("doc_id"),
                    F.col("n").alias("n_shingles"),
                    component.alias("component_id"),
                    F.coalesce(F.col("id") == component, component.isNull()).alias("kept"),
                )
            )
