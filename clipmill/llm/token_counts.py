"""Token counts of sections from one encoding of the whole document.

Encoding section by section would cut tokens at section borders. Here a document is encoded once, the
lengths of its tokens give each token's span, and the spans are joined with the sections' spans. A
token that crosses a border is allocated by an explicit rule:

    first     to the section that holds its first byte
    most      to the section that holds most of its bytes, the earlier one on a tie
    share     to every section it touches, by its share of bytes

Spans are in bytes of UTF-8 while joining, since a token may end inside a character, and sections are
given and returned in characters. Encoding is done by a public byte-level BPE vocabulary whose file is
a parameter; it is read once on the driver and sent to the tasks (about 1 MB).

Defined results: a null or empty text has no sections by line. Sections may overlap, be empty, or lie
outside the text: each gets what it covers, nothing for an empty one. Repeated rows are all counted.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmill.llm.common import quoted, text_of
from clipmill.shipping import ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words with their leading space, numbers, runs of other signs, white space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Result rows of one Arrow batch.
ROWS_OUT = 20_000
RULES = ("first", "most", "share")


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Encoder:
    """The encoding with the byte length of each token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.encoding = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def borders(self, text: str) -> np.ndarray:
        """The byte at which each token starts, and the end of the last."""
        tokens = np.array(self.encoding.encode_ordinary(text), dtype=np.int64)
        return np.concatenate(([0], np.cumsum(self.lengths[tokens])))


def count(borders: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section [start, end) in bytes, for tokens between ``borders``."""
    ends = np.maximum(ends, starts)
    if rule == "share":
        mass = np.arange(len(borders), dtype=np.float64)  # tokens before a byte, parts included
        return np.interp(ends, borders, mass) - np.interp(starts, borders, mass)
    if rule == "first":
        at = borders[:-1]
    elif rule == "most":  # a token belongs where its middle lies, the earlier byte on a tie
        at = (borders[:-1] + borders[1:] - 1) // 2
    else:
        raise ValueError(f"unknown rule {rule!r}; known: {RULES}")
    return (np.searchsorted(at, ends) - np.searchsorted(at, starts)).astype(np.float64)


def crossing(borders: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Tokens that lie partly in a section."""
    cut = lambda x: ~np.isin(x, borders) & (x > 0) & (x < borders[-1])
    a, b = np.searchsorted(borders, starts, "right"), np.searchsorted(borders, ends, "right")
    both = cut(starts).astype(np.int64) + cut(ends)
    return np.where(ends > starts, np.where((a == b) & (both == 2), 1, both), 0)


def _batch(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def attribute(
    docs: DataFrame,
    ranks: dict[bytes, int],
    rule: str = "most",
    text: str = "text",
    doc_id: str = "doc_id",
    sections: str | None = None,
) -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing) for every section of every document.

    ``sections`` names a column array<struct<name, start, end>> in characters; without it lines are
    the sections. ``n_tokens`` follows ``rule``; ``n_crossing`` counts tokens partly inside.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}; known: {RULES}")
    spark = docs.sparkSession
    ship(spark)
    body = text_of(text)
    if sections is None:
        breaks = F.lit(None).cast("array<struct<name:string,start:int,end:int>>")
    else:
        breaks = F.col(quoted(sections)).cast("array<struct<name:string,start:int,end:int>>")
    shared, by_line = spark.sparkContext.broadcast(ranks), sections is None
    schema = pa.schema(
        [("doc_id", pa.int64()), ("section", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
         ("n_tokens", pa.float64()), ("n_crossing", pa.int64())]
    )

    def lines(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
        ends = np.cumsum([len(x) + 1 for x in text.split("\n")]) if text else np.empty(0, dtype=np.int64)
        return [str(i) for i in range(len(ends))], np.concatenate(([0], ends[:-1])) if len(ends) else ends, ends

    def given(spans: list | None) -> tuple[list[str], np.ndarray, np.ndarray]:
        spans = spans or []
        pick = lambda k: np.array([s[k] or 0 for s in spans], dtype=np.int64)
        return [s["name"] for s in spans], pick("start"), pick("end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            found: list[list] = [[] for _ in schema]
            for k, (row_id, content) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                names, starts, ends = lines(content) if by_line else given(batch.column(2)[k].as_py())
                if not names:
                    continue
                data = content.encode("utf-8", "surrogatepass")
                begins = np.flatnonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)
                places = np.append(begins, len(data))  # byte of each character
                at = lambda x: places[np.clip(x, 0, len(places) - 1)]  # noqa: B023, E731
                borders = encoder.borders(content)
                tokens, partly = count(borders, at(starts), at(ends), rule), crossing(borders, at(starts), at(ends))
                ends = np.minimum(ends, len(places) - 1)
                for column, values in zip(found, ([row_id] * len(names), names, starts, ends, tokens, partly)):
                    column.extend(values if isinstance(values, list) else values.tolist())
                if len(found[0]) >= ROWS_OUT:
                    yield _batch(found, schema)
                    found = [[] for _ in schema]
            yield _batch(found, schema)

    rows = docs.select(F.col(quoted(doc_id)).cast("long").alias("i"), body.alias("t"), breaks.alias("s"))
    return rows.mapInArrow(run, "doc_id long, section string, start long, end long, n_tokens double, n_crossing long")
