"""Benchmark passages in documents, by the q-gram lemma in diagonal bands and banded alignment.

A passage of w bytes that occurs with at most k edits shares at least w + 1 - q - kq of its q-grams
with the document, on diagonals (document position minus passage position) that lie within k of each
other. Diagonals are cut into bands of 2(k + 1) that overlap by half, so one band holds all of them.
Shared q-grams are counted by passage and band; bands that reach the bound are aligned, letter by
letter within the band, and kept if the alignment needs at most k edits.

Case is folded over all of Unicode, character by character, and runs of ASCII white space count as one
space, in passages and documents, before the bytes are cut; so shouting costs no edit in any script.
Sharp s is ss, the sigmas are one letter, and so are the dotted and dotless i of Turkish. Lengths and
edits count bytes of the folded text.
Documents are scanned whole, in numpy, where they lie: no document is shuffled. Passages are read in
blocks of at most `Budget.block_bytes` (their sizes are summed first); each block goes to all tasks.
Where many passages share a phrase that a document repeats, q-grams are counted in windows that overlap
by more than a passage, and bands are aligned together, as rows of a matrix from which those fall out
that are over their budget.

Defined results: null and empty texts hold no passage; very long ones are read whole. Null document ids
are reported as null. Only the named columns of the documents are read by `find_passages`, so others may
clash with its own. Passages shorter than a q-gram (`Budget.least` bytes), or null, are no evidence and
are not searched; those too short for an edit are found where they stand verbatim. Equal passages are reported under each of their ids. Repeated
documents are each reported. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmill.llm import shingles
from clipmill.llm.common import quoted
from clipmill.shipping import ship

#: Bytes of a q-gram; eight are packed in one word and two in another.
Q = 10
_BITS = 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32
#: Shared q-grams counted at a time, and places of the matrix of bands aligned together.
_SHARED, _PLACES = 1 << 21, 1 << 20
#: No character from here on has a case.
_CASED = 0x20000
_DOT_ABOVE = 0x307


@dataclass(frozen=True)
class Budget:
    """A passage may differ in ``share`` of its bytes."""

    share: float = 0.08
    least: int = Q
    block_bytes: int = 4 << 20

    def edits(self, length: int) -> int:
        """The budget, lowered where the bound would vanish."""
        return max(0, min(math.floor(self.share * length), (length - Q) // Q))


def fold(char: str) -> str:
    """The one form of a character and its capitals and small letters; most often one character."""
    return "i" if char == "\u0130" else char.upper().casefold()


@functools.cache
def _folds() -> tuple[np.ndarray, np.ndarray]:
    """Three characters for each below `_CASED`, filled up with zeros, and how many there are."""
    table, count = np.zeros((_CASED, 3), dtype=np.uint32), np.ones(_CASED, dtype=np.int64)
    table[:, 0] = np.arange(_CASED)
    table[[9, 10, 11, 12, 13], 0] = 32
    for code in range(65, _CASED):
        folded = fold(chr(code))
        table[code, : len(folded)], count[code] = [ord(c) for c in folded], len(folded)
    return table, count


def _plain(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the folded text without repeated spaces, and the character in ``raw`` of each."""
    if raw.isascii():
        folded = _LOWER[np.frombuffer(raw, dtype=np.uint8)]
        places = np.arange(len(folded))
    else:
        codes = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        table, count = _folds()
        cased = np.where(codes < _CASED, codes, 0)
        counts = count[cased]
        places = np.repeat(np.arange(len(codes)), counts)
        nth = np.arange(len(places)) - np.repeat(np.cumsum(counts) - counts, counts)
        folded = np.where(codes[places] < _CASED, table[cased[places], nth], codes[places])
        keep = np.ones(len(folded), dtype=bool)
        keep[1:] = (folded[1:] != _DOT_ABOVE) | (folded[:-1] != ord("i"))  # what lower() leaves of a dotted capital
        folded, places = folded[keep], places[keep]
    space = folded == 32
    keep = np.ones(len(folded), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    folded, places = folded[keep], places[keep]
    if folded.dtype == np.uint8:
        return folded, places
    text = folded.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    widths = 1 + (folded >= 0x80) + (folded >= 0x800) + (folded >= 0x10000)
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), np.repeat(places, widths)


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the q-gram at each position."""
    if len(data) < Q:
        return np.empty(0, dtype=np.uint64)
    one = data.astype(np.uint64)
    two = one[:-1] | (one[1:] << np.uint64(8))
    four = two[:-2] | (two[2:] << np.uint64(16))
    eight = four[:-4] | (four[4:] << np.uint64(32))
    return shingles.mixed(eight[: len(data) - Q + 1] ^ (two[8:] * np.uint64(0x9E3779B97F4A7C15)))


class Passages:
    """The q-grams of a block of passages: sorted, with the passages and positions of each."""

    def __init__(self, items: list[tuple[int, str]], budget: Budget):
        self.ids, self.data = [], []
        for item_id, text in items:
            data = _plain((text or "").encode("utf-8", "surrogatepass").replace(b"\0", b" ").strip())[0]
            if len(data) >= max(budget.least, Q):
                self.ids.append(item_id)
                self.data.append(data)
        self.edits = np.array([budget.edits(len(d)) for d in self.data], dtype=np.int64)
        lengths = np.array([len(d) for d in self.data], dtype=np.int64)
        self.bound = np.maximum(lengths + 1 - Q - self.edits * Q, 1)
        grams = [_grams(d) for d in self.data]
        all_grams = np.concatenate(grams) if grams else np.empty(0, dtype=np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, dtype=np.int64)
        order = np.argsort(all_grams, kind="stable")
        self.grams, self.first, self.count = np.unique(all_grams[order], return_index=True, return_counts=True)
        self.item, self.place = item[order], place[order]
        self.seen = np.zeros(1 << _BITS, dtype=bool)
        self.seen[(self.grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def bands(self, data: np.ndarray) -> list[tuple[int, int]]:
        """(passage, lowest diagonal) of each band that reaches the bound."""
        codes = _grams(data)
        if not len(self.grams) or not len(codes):
            return []
        at = np.flatnonzero(self.seen[(codes >> np.uint64(64 - _BITS)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.grams, codes[at]), len(self.grams) - 1)
        hit = self.grams[slot] == codes[at]
        at, slot = at[hit], slot[hit]
        extent = self.largest + 2 * int(self.edits.max() + 1) + Q  # no band reaches farther than this
        found: set[tuple[int, int]] = set()
        windows = [(0, len(at))]
        while windows:
            first, end = windows.pop()
            if self.count[slot[first:end]].sum() > _SHARED and at[end - 1] - at[first] > 3 * extent:
                middle = (at[first] + at[end - 1]) // 2
                windows.append((first, int(np.searchsorted(at, middle + extent))))
                windows.append((int(np.searchsorted(at, middle)), end))
            else:
                found.update(self._reaching(at[first:end], slot[first:end], len(data)))
        return sorted(found)

    def _reaching(self, at: np.ndarray, slot: np.ndarray, size: int) -> list[tuple[int, int]]:
        """The bands that reach the bound with the q-grams at these places of a text."""
        counts = self.count[slot]
        total = int(counts.sum())
        if not total:
            return []
        rank = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
        entry = np.repeat(self.first[slot], counts) + rank
        item = self.item[entry]
        diagonal = np.repeat(at, counts) - self.place[entry] + 2 * self.largest
        width = self.edits[item] + 1
        low = diagonal // width
        span = np.int64(size + 3 * self.largest + 2)
        keys, shared = np.unique(np.concatenate((item * span + low, item * span + low - 1)), return_counts=True)
        items, low = keys // span, keys % span
        enough = shared >= self.bound[items]
        items, low = items[enough], low[enough]
        return list(zip(items.tolist(), (low * (self.edits[items] + 1) - 2 * self.largest).tolist()))

    @functools.cached_property
    def largest(self) -> int:
        return max((len(d) for d in self.data), default=0)


def aligned(
    passage: np.ndarray, data: np.ndarray, low: int, width: int, most: int, free: bool = True
) -> tuple[int, int]:
    """Fewest edits between ``passage`` and a stretch of ``data``, and where the stretch ends.

    Only diagonals ``low`` to ``low + width - 1`` are filled. With ``free`` the stretch may start on
    any of them, else at the first letter. Stops as soon as more than ``most`` edits are certain.
    """
    steps = np.arange(width)
    padded = np.full(len(passage) + width, 256, dtype=np.int16)  # 256 matches nothing
    a, b = max(low, 0), min(low + len(padded), len(data))
    if b > a:
        padded[a - low : b - low] = data[a:b]
    cost = np.zeros(width, dtype=np.int64) if free else np.where(steps + low < 0, 2 * len(passage) + width, steps + low)
    for i, letter in enumerate(passage):
        best = cost + (padded[i : i + width] != letter)
        best[:-1] = np.minimum(best[:-1], cost[1:] + 1)
        cost = np.minimum.accumulate(best - steps) + steps
        if i % 8 == 7 and cost.min() > most:
            return most + 1, 0
    end = int(np.argmin(cost))
    return int(cost[end]), low + len(passage) + end


def within(
    passages: Passages, data: np.ndarray, items: np.ndarray, lows: np.ndarray, lefts: np.ndarray, rights: np.ndarray
) -> np.ndarray:
    """Which bands may hold their passage within its budget: many at a time, as the rows of a matrix.

    A band is a passage, a lowest diagonal in ``data`` and the borders of its text; one diagonal more
    than `aligned` fills is allowed.
    """
    good = np.zeros(len(items), dtype=bool)
    budgets = passages.edits[items]
    lengths = np.array([len(passages.data[i]) for i in items.tolist()], dtype=np.int64)
    for edits in np.unique(budgets).tolist():
        steps = np.arange(2 * (edits + 1) + 2, dtype=np.int32)
        of_budget = np.flatnonzero(budgets == edits)
        of_budget = of_budget[np.argsort(lengths[of_budget], kind="stable")]
        rows = max(1, _PLACES // max(len(steps), int(lengths[of_budget].max())))
        for k in range(0, len(of_budget), rows):
            at = of_budget[k : k + rows]
            used, nth = np.unique(items[at], return_inverse=True)
            letters = np.zeros((len(used), int(lengths[at].max())), dtype=np.uint8)
            for j, i in enumerate(used.tolist()):
                letters[j, : len(passages.data[i])] = passages.data[i]
            cost = np.zeros((len(at), len(steps)), dtype=np.int32)
            for i in range(letters.shape[1]):
                where = (lows[at] + i)[:, None] + steps
                inside = (where >= lefts[at][:, None]) & (where < rights[at][:, None])
                same = inside & (data[np.where(inside, where, 0)] == letters[nth, i][:, None])
                best = cost + ~same
                best[:, :-1] = np.minimum(best[:, :-1], cost[:, 1:] + 1)
                cost = np.minimum.accumulate(best - steps, axis=1) + steps
                ended = lengths[at] == i + 1
                if ended.any() or i % 8 == 7:
                    able = cost.min(axis=1) <= edits
                    good[at[ended & able]] = True
                    stay = able & ~ended
                    at, nth, cost = at[stay], nth[stay], cost[stay]
                    if not len(at):
                        break
    return good


def _verbatim(passages: Passages, data: np.ndarray, borders: np.ndarray, item: int, low: int, text: int) -> int:
    """Where in its text a passage stands unchanged near a diagonal, or -1."""
    left, right = int(borders[text]) + 1, int(borders[text + 1])
    passage, width = passages.data[item], 2 * (int(passages.edits[item]) + 1) + 1
    first, end = max(low, left), min(low + len(passage) + width, right)
    at = data[first:end].tobytes().find(passage.tobytes()) if first < end else -1
    return at if at < 0 else first - left + at


def search(passages: Passages, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
    """(text, passage id, first character, end character, edits) of every passage found."""
    data, places = _plain(b"\0" + b"\0".join(t.replace(b"\0", b" ") for t in texts) + b"\0")
    borders = np.flatnonzero(data == 0)
    found: dict[tuple[int, int, int], tuple[int, int]] = {}
    bands = np.array(passages.bands(data), dtype=np.int64).reshape(-1, 2)
    items, lows = bands[:, 0], bands[:, 1]
    halves = np.array([len(passages.data[i]) // 2 for i in items.tolist()], dtype=np.int64)
    of_text = np.searchsorted(borders, np.maximum(lows, 0) + halves) - 1
    known = (of_text >= 0) & (of_text < len(texts))
    items, lows, of_text = items[known], lows[known], of_text[known]
    verbatim = np.array([_verbatim(passages, data, borders, *x) for x in zip(items.tolist(), lows.tolist(), of_text.tolist())], dtype=np.int64)
    rest = np.flatnonzero(verbatim < 0)
    good = verbatim >= 0
    good[rest] = within(passages, data, items[rest], lows[rest], borders[of_text[rest]] + 1, borders[of_text[rest] + 1])
    for item, low, text, start in np.stack((items, lows, of_text, verbatim), 1)[good].tolist():
        passage, edits = passages.data[item], int(passages.edits[item])
        left, right = int(borders[text]) + 1, int(borders[text + 1])
        body, width = data[left:right], 2 * (edits + 1) + 1
        if start >= 0:
            cost, end = 0, start + len(passage)
        else:
            cost, end = aligned(passage, body, low - left, width, edits)
            if cost > edits:
                continue
            end = min(max(end, 0), len(body))
            back = aligned(passage[::-1], body[:end][::-1], -edits, 2 * edits + 1, edits, free=False)
            start = max(end - back[1], 0)
        key = (text, item, end)
        if key not in found or cost < found[key][1]:
            found[key] = (start, cost)
    rows = []
    for (text, item, end), (start, cost) in sorted(_apart(found)):
        left = int(borders[text]) + 1
        origin = int(places[borders[text]]) + 1
        first = int(places[left + start]) - origin
        # one past the last character that is matched to its last byte
        last = min(int(places[left + end - 1]) + 1, int(places[left + end])) - origin
        rows.append((text, passages.ids[item], first, last, cost))
    return rows


def _apart(found: dict) -> Iterator[tuple[tuple[int, int, int], tuple[int, int]]]:
    """Of overlapping finds of one passage, the one with the fewest edits."""
    taken: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for (text, item, end), (start, cost) in sorted(found.items(), key=lambda x: (x[1][1], x[0])):
        spans = taken.setdefault((text, item), [])
        if all(end <= a or start >= b for a, b in spans) and end > start:
            spans.append((start, end))
            yield (text, item, end), (start, cost)


def _blocks(benchmark: DataFrame, budget: Budget, item_id: str, text: str) -> Iterator[Passages]:
    rows = benchmark.select(F.col(quoted(item_id)).cast("long").alias("i"), F.col(quoted(text)).cast("string").alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(size / budget.block_bytes))
    for b in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        yield Passages([(r.i, r.t) for r in block.collect()], budget)


def _scan(passages: Passages) -> Callable:
    """A function from a column of texts to the passages in them, by row."""

    def run(texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        rows = []
        for part, data in shingles.chunks(texts):
            rows += [(part.start + r[0], *r[1:]) for r in search(passages, data)]
        return rows

    return run


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    budget: Budget = Budget(),
    text: str = "text",
    doc_id: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
) -> DataFrame:
    """(doc_id, item_id, start, end, edits): every passage in every document, by characters."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(quoted(doc_id)).cast("long").alias("i"), F.col(quoted(text)).cast("string").alias("t"))
    names = ("doc_id", "item_id", "start", "end", "edits")
    schema = pa.schema([(n, pa.int64()) for n in names])
    result = None
    for passages in _blocks(benchmark, budget, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(passages)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            scan = _scan(shared.value)
            for batch in batches:
                ids, rows = batch.column(0), scan(batch.column(1).to_pylist())
                at = pa.array([r[0] for r in rows], pa.int64())
                rest = [pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3, 4)]
                yield pa.RecordBatch.from_arrays([ids.take(at), *rest], schema=schema)

        part = docs.mapInArrow(find, ", ".join(f"`{n}` long" for n in names))
        result = part if result is None else result.union(part)
    return result


def without_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    budget: Budget = Budget(),
    text: str = "text",
    item_text: str = "text",
    item_id: str = "item_id",
) -> DataFrame:
    """The rows of ``docs`` that hold no passage, with all their columns; nothing is shuffled."""
    ship(docs.sparkSession)
    at = docs.columns.index(text)
    for passages in _blocks(benchmark, budget, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(passages)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            scan = _scan(shared.value)
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[r[0] for r in scan(batch.column(at).to_pylist())]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
