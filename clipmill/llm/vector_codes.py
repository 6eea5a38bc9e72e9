"""Short codes for vectors by product quantisation in integers, with pivots to spare distances.

Every component x becomes floor(4096 x), and a vector is cut into equal consecutive parts. Each part position
has a codebook that starts as that part of the vectors with the smallest ids. A round assigns every part to the
nearest entry (squared Euclidean distance, ties to the lower index) and moves each entry to the floored mean of
its parts; entries without parts stay. A code is the entry numbers after the last round.

Distances are spared as in LAESA: for each position a few of the first entries, far from each other, are fixed
as pivots, and the distance of every part to its pivots is computed once and stored beside the part. In a
round only the entries' distances to the pivots are new. By the triangle inequality |d(part, pivot) -
d(entry, pivot)| is at most d(part, entry); the largest of these bounds over the pivots orders a part's
entries. They are evaluated exactly, in 64-bit integers, in that order until the next bound is beyond the
best distance, which rules out the rest. Bounds are lowered by `SLACK` for the rounding of stored distances,
and an equal bound is still evaluated, so the result is that of all distances.

A round is a scan of the stored parts; each task sends counts and sums of entries (parts x entries x part
length numbers), which are added up by key. The driver holds the codebooks alone. The final assignment is
stored once and read for the label sums and the result.

Defined results: a vector that is null, empty, or holds a null or non-finite component is dropped, and so is
one whose length is not that of most others (the shorter length on a tie), which has no code in the same
books. Rows with one id are all coded; ids that are null come last in the order of the first entries, and
equal ids are ordered by their components. With fewer vectors than entries the books are smaller; an empty
table gives an empty result. A length that cannot be cut into equal parts, or a component of `LARGEST` or
more in size, whose distances do not fit into 64 bits, is an error. Only named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmill import storage
from clipmill.llm.common import cut, quoted
from clipmill.operators.joins import spread_lookup
from clipmill.shipping import ship

#: Share by which a bound is lowered: stored distances are 32-bit floats, right to 6e-8 of their size.
SLACK = 1e-6
#: Components must be below this, so that distances and sums over 2^33 rows fit into 64 bits.
LARGEST = 1 << 17
#: Vectors a task works on at once.
ROWS = 4_096


@dataclass(frozen=True)
class Books:
    """``parts`` codebooks of up to ``entries`` entries, ``rounds`` rounds, ``pivots`` fixed pivots each."""

    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096
    pivots: int = 3

    def __post_init__(self):
        if not 1 <= self.entries <= 256:
            raise ValueError("an entry number must fit into two hex digits: 1 to 256 entries")


def _distances(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Distances (not squared) of parts (n, width) to entries (k, width)."""
    return np.sqrt(((parts[:, None, :] - entries[None]) ** 2).sum(axis=2))


def choose_pivots(entries: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` of the entries: the first, then each time the one farthest from those chosen."""
    chosen = [0]
    nearest = ((entries - entries[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(entries)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((entries - entries[chosen[-1]]) ** 2).sum(axis=1))
    return entries[chosen]


def nearest(parts: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each part's nearest entry, their squared distance, and how many distances were evaluated.

    ``to_pivots`` holds the stored distances of the parts (n, width) to the pivots.
    """
    of_entries = _distances(pivots, entries)  # pivots x entries
    bound = np.zeros((len(parts), len(entries)))
    for p in range(len(pivots)):
        a, b = to_pivots[:, p, None].astype(np.float64), of_entries[p]
        np.maximum(bound, np.abs(a - b) - SLACK * (a + b), out=bound)
    bound *= bound
    order = np.argsort(bound, axis=1, kind="stable")
    best = np.full(len(parts), np.iinfo(np.int64).max)
    code = np.zeros(len(parts), dtype=np.int64)
    rows, evaluated = np.arange(len(parts)), 0
    for rank in range(len(entries)):
        entry = order[rows, rank]
        open_ = bound[rows, entry] <= best[rows]
        rows, entry = rows[open_], entry[open_]  # bounds ascend: who stops here is done
        if not len(rows):
            break
        evaluated += len(rows)
        found = ((parts[rows] - entries[entry]) ** 2).sum(axis=1)
        better = (found < best[rows]) | ((found == best[rows]) & (entry < code[rows]))
        best[rows[better]], code[rows[better]] = found[better], entry[better]
    return code, best, evaluated


def _usable(vector: Column) -> Column:
    holds = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(holds, F.lit(False))


def _integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))


def _with_pivots(rows: DataFrame, pivots: list[np.ndarray], books: Books) -> DataFrame:
    """The rows with ``parts`` (32-bit integers) and ``near``, the distances to the pivots, as bytes."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("parts", pa.binary()), ("near", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), ROWS):
                piece = batch.slice(k, ROWS)
                flat = piece.column(2).flatten().to_numpy()
                if len(flat) and np.abs(flat).max() >= LARGEST:
                    raise ValueError(f"a component times {books.scale} is {LARGEST} or more")
                values = flat.reshape(len(piece), books.parts, -1)
                near = [_distances(values[:, j], pivots[j]) for j in range(books.parts)]
                near = np.concatenate(near, axis=1).astype("<f4")
                columns = [[x.tobytes() for x in block] for block in (values.astype("<i4"), near)]
                arrays = [piece.column(0), piece.column(1), *[pa.array(c, pa.binary()) for c in columns]]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return rows.mapInArrow(run, "vec_id long, label string, parts binary, near binary")


class _Assigner:
    """Assignment of stored rows to one state of the codebooks."""

    def __init__(self, entries: list[np.ndarray], pivots: list[np.ndarray]):
        self.entries, self.pivots = entries, pivots

    def pieces(self, batches: Iterator[pa.RecordBatch], parts: str, near: str) -> Iterator[tuple]:
        """(slice of a batch, components, codes, squared distances) of up to `ROWS` rows each."""
        n, cuts = len(self.entries), np.cumsum([len(p) for p in self.pivots])[:-1]
        for batch in batches:
            for k in range(0, len(batch), ROWS):
                piece = batch.slice(k, ROWS)
                read = lambda c, kind: np.frombuffer(b"".join(piece.column(c).to_pylist()), kind)  # noqa: B023, E731
                values = read(parts, "<i4").astype(np.int64).reshape(len(piece), n, -1)
                to_pivots = np.split(read(near, "<f4").reshape(len(piece), -1), cuts, axis=1)
                found = [nearest(values[:, j], to_pivots[j], self.entries[j], self.pivots[j])[:2] for j in range(n)]
                yield piece, values, np.stack([c for c, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def _moved(stored: DataFrame, entries: list[np.ndarray], pivots: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after a round. Tasks send one row for each number of the books."""
    width = entries[0].shape[1]
    schema = pa.schema([("place", pa.int64()), ("total", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(e), width + 1), dtype=np.int64) for e in entries]  # the last column counts
        for _, values, codes, _ in _Assigner(entries, pivots).pieces(batches, "parts", "near"):
            for j, own in enumerate(sums):
                np.add.at(own[:, :width], codes[:, j], values[:, j])
                own[:, width] += np.bincount(codes[:, j], minlength=len(own))
        flat = np.concatenate([s.ravel() for s in sums])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], schema=schema)

    sums = stored.mapInArrow(run, "place long, total long").groupBy("place").agg(F.sum("total").alias("total"))
    flat = np.zeros(sum(len(e) * (width + 1) for e in entries), dtype=np.int64)
    for row in sums.collect():  # a row for each number of the books
        flat[row.place] = row.total
    out, at = [], 0
    for e in entries:
        own = flat[at : at + len(e) * (width + 1)].reshape(len(e), width + 1)
        at += own.size
        used = own[:, width:] > 0
        out.append(np.where(used, own[:, :width] // np.where(used, own[:, width:], 1), e))
    return out


def _codes(stored: DataFrame, entries: list[np.ndarray], pivots: list[np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, _, codes, distances in _Assigner(entries, pivots).pieces(batches, "parts", "near"):
            text = [x.tobytes().hex() for x in codes.astype(np.uint8)]
            columns = [piece.column("vec_id"), piece.column("label"), pa.array(text), pa.array(distances.sum(axis=1))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    return stored.mapInArrow(run, "vec_id long, label string, code string, error long")


def encode(
    rows: DataFrame, books: Books = Books(), vector: str = "embedding", vec_id: str = "vec_id", label: str = "label"
) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every usable vector; labels as text."""
    spark = rows.sparkSession
    ship(spark)
    values = F.col(quoted(vector)).cast("array<double>")
    rows = rows.select(
        F.col(quoted(vec_id)).cast("long").alias("vec_id"), F.col(quoted(label)).cast("string").alias("label"), values.alias("v")
    ).where(_usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    empty = spark.createDataFrame([], "vec_id long, label string, code string, error long, label_error long, codebooks_sha256 string")
    if not lengths:
        return empty
    length = lengths[0].n
    if length % books.parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {books.parts} equal parts")
    rows = rows.where(F.size("v") == length).select("vec_id", "label", _integers(F.col("v"), books.scale).alias("v"))
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(books.entries).collect()
    start = np.array([r.v for r in first], dtype=np.int64).reshape(len(first), books.parts, -1)
    entries = [start[:, j] for j in range(books.parts)]
    pivots = [choose_pivots(e, books.pivots) for e in entries]
    with storage.staged(_with_pivots(rows, pivots, books), "vector-parts") as stored:
        for _ in range(books.rounds):
            entries = _moved(stored, entries, pivots)
        coded = cut(_codes(stored, entries, pivots))
    numbers = ",".join(str(x) for e in entries for x in e.ravel().tolist())
    sha = hashlib.sha256(numbers.encode()).hexdigest()
    known = coded.where("label is not null").groupBy("label").agg(F.sum("error").alias("label_error"))
    unlabelled = F.lit(coded.where("label is null").agg(F.sum("error")).first()[0]).cast("long")
    with_sum = spread_lookup(coded, known, "label", "vec_id")
    total = F.coalesce("label_error", unlabelled).alias("label_error")
    return with_sum.select("vec_id", "label", "code", "error", total, F.lit(sha).alias("codebooks_sha256"))
