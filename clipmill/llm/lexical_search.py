"""The k best documents of each query by term weights, found through presence masks.

A task holds a block of documents as a bit for each (term, document): does the document hold the term? The
bits of a query's terms, read across, are a document's presence mask, and documents with one mask form a
group: the query's bitmaps are combined, and groups are split, term by term until all are used. A mask's
score is at most the sum, over its terms, of the most that the term gives any document of the block. Masks
are evaluated by descending maximum; the search of a block ends when k documents are known (from this or
an earlier block of the task) whose scores are all above the next maximum. Equal maxima are still
evaluated, since ties go by doc_id. So nothing is skipped that could be among the best.

1. One scan counts documents, their terms, and the documents of each query term (sums of task totals).
2. One scan searches. A task sends k rows a query at most; they are ranked in two steps, so that one task
   ranks the results of a part of all tasks. No document and no (query, document) pair is shuffled.

Queries are searched in blocks of bounded size (`BLOCK_ITEMS` queries, `BLOCK_BYTES` of text), each block
sent to all tasks, with the two scans for each block.

Terms are the maximal runs of letters, digits and non-ASCII characters of the whole text, A-Z in lower case.
With N documents that hold a term, L terms in them, n in this one, df documents with the term:

    weight    floor(1000 * ln((2 N + 2) / (2 df + 1)))
    length    m = 10 + (90 n N) div L
    score     sum of weight * ((10^9 tf) div (1000 tf + 8 m)) over the query's distinct terms

Defined results: a null or empty text has no term, as a document it is never counted or found, as a query
it finds nothing. Documents without an id come after all others on a tie. Repeated documents are all
ranked; equal rows stay in no stated order, being equal. Repeated queries are answered as often as they
occur. Empty tables give an empty result. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipmill.llm.common import cut, partitions_for, quoted, text_of
from clipmill.shipping import ship

#: Queries, and bytes of their texts, searched at once.
BLOCK_ITEMS, BLOCK_BYTES = 2_000, 4 << 20
#: Documents of a block of a task, and presence bits (documents x terms) it may hold.
BLOCK_DOCS, BLOCK_BITS = 4_096, 1 << 26
#: Columns of the result.
RANKED = "item_id long, rank int, doc_id long, score long"
#: Terms whose bits are combined before groups are numbered anew.
BITS = 40
#: Masks are evaluated until so many documents are, then twice as many, and so on.
FIRST = 64
#: A-Z become a-z, other ASCII that is no digit or letter becomes a space.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Queries:
    """A block of queries over one list of terms."""

    def __init__(self, texts: list[str]):
        self.number: dict[bytes, int] = {}
        self.terms = [
            np.array(sorted({self.number.setdefault(t, len(self.number)) for t in terms_of(x)}), dtype=np.int64)
            for x in texts
        ]

    def counts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The query terms among ``words`` and how often each occurs."""
        found = np.fromiter(map(self.number.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        return np.unique(found[found >= 0], return_counts=True)


class Weights:
    """Weights by term number, with what a document's length needs."""

    def __init__(self, documents: int, terms: int, holders: np.ndarray):
        self.documents, self.terms = documents, terms
        self.weight = np.array(
            [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in holders], dtype=np.int64
        )

    def lengths(self, sizes: list[int]) -> np.ndarray:
        return np.array([10 + 90 * n * self.documents // self.terms for n in sizes], dtype=np.int64)


class Block:
    """Documents with their query terms: what each term adds, and one row of presence bits a term."""

    def __init__(self, ids: list, found: list[tuple[np.ndarray, np.ndarray]], sizes: list[int], weights: Weights):
        n_terms, n = len(weights.weight), len(ids)
        self.ids = np.array([0 if i is None else i for i in ids], dtype=np.int64)
        self.lost = np.array([i is None for i in ids], dtype=bool)
        doc = np.repeat(np.arange(n), [len(t) for t, _ in found])
        term = np.concatenate([t for t, _ in found])
        tf = np.concatenate([c for _, c in found])
        gain = weights.weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * weights.lengths(sizes)[doc]))
        order = np.lexsort((doc, term))
        self.keys, self.gain, self.n = term[order] * n + doc[order], gain[order], n
        self.first = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.most = np.zeros(n_terms, dtype=np.int64)
        np.maximum.at(self.most, term, gain)
        self.bits = np.zeros((n_terms, n), dtype=bool)
        self.bits[term, doc] = True

    def masks(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents sorted by mask, the first of each group (with the end), and each group's maximum."""
        group, most = np.zeros(self.n, dtype=np.int64), np.zeros(1, dtype=np.int64)
        for k in range(0, len(terms), BITS):
            part = terms[k : k + BITS]
            code = np.zeros(self.n, dtype=np.int64)
            for i, t in enumerate(part):
                code |= self.bits[t].astype(np.int64) << i
            if k:  # at most BLOCK_DOCS groups so far, so that number and bits fit into 63 bits
                code |= group << BITS
            found, group = np.unique(code, return_inverse=True)
            own = np.zeros(len(found), dtype=np.int64)
            for i, t in enumerate(part):
                own += np.where(found >> i & 1, self.most[t], 0)
            most = own + (most[found >> BITS] if k else 0)
        order = np.argsort(group, kind="stable")
        return order, np.searchsorted(group[order], np.arange(len(most) + 1)), most

    def scores(self, docs: np.ndarray, terms: np.ndarray) -> np.ndarray:
        total = np.zeros(len(docs), dtype=np.int64)
        for t in terms:
            a, b = self.first[t], self.first[t + 1]
            if a == b:
                continue
            at = np.minimum(np.searchsorted(self.keys[a:b], t * self.n + docs), b - a - 1)
            total += np.where(self.keys[a:b][at] == t * self.n + docs, self.gain[a:b][at], 0)
        return total


class Best:
    """The best k documents of one query so far."""

    def __init__(self, k: int):
        self.k, self.evaluated = k, 0
        self.score = self.id = np.empty(0, dtype=np.int64)
        self.lost = np.empty(0, dtype=bool)

    @property
    def least(self) -> int:
        """A document below this score cannot be among the best; one of this score can, by its id."""
        return max(1, int(self.score[-1])) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, lost: np.ndarray) -> None:
        keep = score >= self.least
        score, ids = np.concatenate((self.score, score[keep])), np.concatenate((self.id, ids[keep]))
        lost = np.concatenate((self.lost, lost[keep]))
        order = np.lexsort((ids, lost, -score))[: self.k]
        self.score, self.id, self.lost = score[order], ids[order], lost[order]

    def search(self, block: Block, terms: np.ndarray) -> None:
        """Take in a block, mask by mask."""
        terms = terms[block.first[terms + 1] > block.first[terms]]
        if not len(terms) or block.most[terms].sum() < self.least:
            return
        docs, first, most = block.masks(terms)
        order = np.argsort(-most, kind="stable")
        k, step = 0, FIRST
        while k < len(order) and most[order[k]] >= self.least:
            size, chosen = 0, []
            while k < len(order) and size < step and most[order[k]] >= self.least:
                group = order[k]
                chosen.append(docs[first[group] : first[group + 1]])
                size, k = size + len(chosen[-1]), k + 1
            some = np.concatenate(chosen)
            self.evaluated += len(some)
            self.add(block.scores(some, terms), block.ids[some], block.lost[some])
            step *= 2


def _statistics(rows: DataFrame, queries: Queries) -> Weights:
    """Documents, terms, and documents of each query term; tasks send their sums."""
    shared = rows.sparkSession.sparkContext.broadcast(queries)
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        holders = np.zeros(len(queries.number) + 2, dtype=np.int64)  # the last two: documents, terms
        for batch in batches:
            for text in batch.column(1).to_pylist():
                words = terms_of(text)
                if words:
                    holders[-2:] += (1, len(words))
                    holders[queries.counts(words)[0]] += 1
        at = np.flatnonzero(holders)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(holders[at])], schema=schema)

    sums = rows.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    holders = np.zeros(len(queries.number) + 2, dtype=np.int64)
    for row in sums.collect():  # one row for each term of the block
        holders[row.term] = row.n
    return Weights(int(holders[-2]), int(holders[-1]), holders[:-2])


def _block(rows: DataFrame, texts: list[str], k: int) -> DataFrame:
    """(query, doc_id, score): the best k of each task for each query, by its place in ``texts``."""
    queries = Queries(texts)
    weights = _statistics(rows, queries)
    shared = rows.sparkSession.sparkContext.broadcast((queries, weights))
    schema = pa.schema([("query", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = shared.value
        best = [Best(k) for _ in queries.terms]
        most_docs = max(1, min(BLOCK_DOCS, BLOCK_BITS // max(1, len(queries.number))))
        ids, found, sizes = [], [], []

        def search() -> None:
            if ids:
                block = Block(ids, found, sizes, weights)
                for one, terms in zip(best, queries.terms):
                    one.search(block, terms)
                for column in (ids, found, sizes):
                    column.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = terms_of(text)
                terms, counts = queries.counts(words)
                if len(terms):
                    ids.append(doc_id)
                    found.append((terms, counts))
                    sizes.append(len(words))
                    if len(ids) == most_docs:
                        search()
        search()
        for q, one in enumerate(best):
            n = len(one.score)
            if n:
                columns = [np.full(n, q), pa.array(one.id, mask=one.lost), one.score]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return rows.mapInArrow(run, "query long, doc_id long, score long")


def _ranked(rows: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    text: str = "text",
    doc_id: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` best documents with a score above 0 for each item."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), text_of(text).alias("text"))
    items = items.select(F.col(quoted(item_id)).cast("long").alias("item_id"), text_of(item_text).alias("text"))
    # Items and results in few files: for each, Hadoop's local file system starts processes out of an executor.
    few = spark.sparkContext.defaultParallelism
    items = cut(items.groupBy("item_id", "text").agg(F.count("*").alias("times")).coalesce(few))
    size = items.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    n_blocks = max(-(-size.n // BLOCK_ITEMS), -(-(size.b or 0) // BLOCK_BYTES))
    out = []
    parts = partitions_for(spark)
    for b in range(n_blocks):
        own = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b)
        block = own.collect()
        found = _block(rows, [r.text for r in block], k).withColumn("part", F.spark_partition_id() % parts)
        best = _ranked(_ranked(found, k, "query", "part").drop("rank", "part"), k, "query").coalesce(few)
        # As Arrow data the names need no Python workers of their own, unlike a list of tuples.
        names = [range(len(block)), [r.item_id for r in block], [r.times for r in block]]
        names = pa.table([pa.array(n, pa.int64()) for n in names], ["query", "item_id", "times"])
        names = spark.createDataFrame(names, "query long, item_id long, times long")
        best = best.join(F.broadcast(names), "query")  # BLOCK_ITEMS rows or so
        best = best.withColumn("time", F.explode(F.sequence(F.lit(1), "times")))
        out.append(best.select("item_id", F.col("rank").cast("int"), "doc_id", "score"))
    return reduce(DataFrame.union, out) if out else spark.createDataFrame([], RANKED)
