"""Token ids of whole documents in Parquet files that can be read selectively.

A document is one row: its id, where it starts among all ids of its file, its number of ids, the ids as a
list column, and any kept columns in the struct `meta`. Rows lie in ascending order of doc_id, within
files and across them. The layout is Parquet's own and any reader can open it:

    encoding      ids by dictionary (one page of the vocabulary, then packed indexes) or by delta blocks;
                  doc_id, start and n_tokens, which hardly change from row to row, always by delta
    row groups    of `group_bytes`, so that a task reads a part of a file
    pages         of at most `page_rows` rows with column and offset indexes: a filter on doc_id reads the
                  pages that hold those documents, and columns that are not asked for are never read

Texts are dealt by ranges of doc_id, sorted, encoded and written in one pass. How many ids stand before a
file is known only when all are written, so rows hold starts within their file (`part`), and a table beside
them, `offsets`, has one row for each file. `read` adds the two. The number of files is a parameter of at
most `MOST_FILES`, which bounds that table (40 bytes a row). It is written last: without it there is no
finished output, and a run that was broken off is repeated over what it left.

Encoding goes word by word where the vocabulary allows it (`by_word`): if white space is dropped and always
ends a token, the ids of a text are those of its words in a row. Words that recur are encoded once per task
or so, and a text of any length costs no more memory than its words and ids. A word of letters, which
normalising leaves alone, goes straight to the tokenizer's model; others go through all its steps in batches.

Defined results: a null or empty text has the end id alone. Rows without a doc_id come first; rows of one
doc_id are ordered by a hash of the text, and equal rows are all kept. An empty table gives files without
rows and an empty result. Columns of other names do no harm: only kept ones are stored, in `meta`.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from clipmill import storage
from clipmill.llm.common import partitions_for, quoted, text_of
from clipmill.shipping import ship

#: Files of one output, and so rows of its table of offsets.
MOST_FILES = 100_000
#: Bytes of text encoded at a time, unless one text has more.
CHUNK = 1 << 18
#: Words of at most so many bytes are remembered, up to twice so many of them.
WORD_BYTES, WORDS = 32, 400_000
#: Words of one call of the tokenizer, with a sign between them that is a token of its own.
CALL, MARK = 4096, "!"
#: Signs that may follow a word without changing its tokens.
TAIL = ".,;:?"
ENCODINGS = ("dictionary", "delta")


@dataclass(frozen=True)
class Layout:
    """How the files are cut; ``files`` is the number of ranges (0: as many as shuffle partitions)."""

    encoding: str = "dictionary"
    files: int = 0
    group_bytes: int = 32 << 20
    page_bytes: int = 1 << 20
    page_rows: int = 1_000
    compression: str = "snappy"

    def options(self) -> dict[str, str]:
        if self.encoding not in ENCODINGS:
            raise ValueError(f"unknown encoding {self.encoding!r}; known: {ENCODINGS}")
        return {
            "compression": self.compression,
            "parquet.writer.version": "PARQUET_2_0",
            "parquet.block.size": str(self.group_bytes),
            "parquet.page.size": str(self.page_bytes),
            "parquet.page.row.count.limit": str(self.page_rows),
            "parquet.dictionary.page.size": str(4 << 20),
            "parquet.enable.dictionary": "true",
            "parquet.enable.dictionary#ids.list.element": str(self.encoding == "dictionary").lower(),
            **{f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "start", "n_tokens")},
        }


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it can be seen, else the next from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def _word(text: str) -> str | None:
    """The text in lower case if it is letters that composing leaves alone: one word, whatever sign follows.

    Capital sigma is left to the tokenizer, which lowers it without regard to its place.
    """
    if text.isascii():
        return text if text.isalpha() and text.islower() else None
    low = text.lower()
    return low if low.isalpha() and "\u03a3" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low) else None


class Encoder:
    """Texts to ids, as little-endian 32-bit integers."""

    def __init__(self, vocabulary: str, by_word: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.by_word = Tokenizer.from_str(vocabulary), by_word
        self.words: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}  # words before those, until they are met again
        if not by_word:
            return
        mark = self.ids([MARK])[0]
        if len(mark) != 4:
            raise ValueError(f"{MARK!r} is not one token of this vocabulary, so words cannot be told apart")
        self.mark = int.from_bytes(mark, "little")
        self.lowers = self.ids(["AB"]) == self.ids(["ab"])
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.four = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        # Whether a word of letters reaches the model as it is; looked at, for any other vocabulary.
        self.direct = self.lowers and all(self._letters(w) == self.ids([w])[0] for w in ("word", "añojado", "строка", "東京都"))

    def ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def encode(self, data: list[bytes]) -> list[bytes]:
        """The ids of texts in UTF-8."""
        if not self.by_word:
            return self.ids([d.decode("utf-8") for d in data])
        if len(self.words) > WORDS:
            self.words, self.old = {}, self.words
        # ASCII capitals are the same word for a lower-casing vocabulary, but for the names of special tokens.
        split = [(d.lower() if self.lowers and b"<|" not in d else d).split() for d in data]
        words = list(chain.from_iterable(split))
        found = list(map(self.words.get, words))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        if gaps:
            fresh = self._fresh({words[i] for i in gaps})
            for i in gaps:
                found[i] = fresh[words[i]]
        rest = iter(found)
        return [b"".join(islice(rest, len(s))) for s in split]

    def _fresh(self, new: set[bytes]) -> dict[bytes, bytes]:
        """The ids of words not met lately; short ones are remembered from now on."""
        fresh, others, tails, old = {}, [], [], self.old
        four, tokenize = self.four, self.model.tokenize
        for word in new:
            ids = old.get(word)
            if ids is None and self.direct and word.isalpha() and word.islower():  # ASCII letters
                ids = b"".join([four[x.id] for x in tokenize(word.decode("ascii"))])
            elif ids is None and self.direct:
                text = word.decode("utf-8")
                core = text.rstrip(TAIL)
                low = _word(core)
                if low is not None:
                    ids = self._letters(low)
                    if len(core) < len(text):
                        tails.append((word, ids, text[len(core) :].encode("utf-8")))
                        continue
            if ids is None:
                others.append(word)
            else:
                fresh[word] = ids
        fresh |= self._words([*others, *{tail for _, _, tail in tails if tail not in fresh}.difference(others)])
        for word, ids, tail in tails:
            fresh[word] = ids + fresh[tail]
        if max(map(len, fresh)) <= WORD_BYTES:
            self.words.update(fresh)
        else:
            self.words.update((w, ids) for w, ids in fresh.items() if len(w) <= WORD_BYTES)
        return fresh

    def _letters(self, word: str) -> bytes:
        """The ids of a word of letters, straight from the model."""
        if not word.isascii():
            word = word.encode("utf-8").decode("latin-1").translate(self.letters)
        four = self.four
        return b"".join([four[x.id] for x in self.model.tokenize(word)])

    def _words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of each word, many in one call, cut apart at the mark between them."""
        texts = [w.decode("utf-8") for w in words]
        # Words that hold the mark, or a special token, go by themselves.
        apart = [i for i, t in enumerate(texts) if MARK in unicodedata.normalize("NFC", t) or "<|" in t]
        out = dict(zip((words[i] for i in apart), self.ids([texts[i] for i in apart]))) if apart else {}
        joined = [w for w in words if w not in out]
        for k in range(0, len(joined), CALL):
            part = joined[k : k + CALL]
            ids = np.frombuffer(self.ids([f" {MARK} ".join(map(bytes.decode, part))])[0], dtype="<u4")
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(part) - 1:
                raise ValueError("words run into each other: encode whole texts (by_word=False)")
            starts, ends = [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]
            out.update((w, ids[a:b].tobytes()) for w, a, b in zip(part, starts, ends))
        return out


_encoders: dict[tuple[int, bool], Encoder] = {}


def _encoder(vocabulary: str, by_word: bool) -> Encoder:
    """One encoder for all tasks of a worker: what words it knows does not change the ids."""
    key = (zlib.crc32(vocabulary.encode()), by_word)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary, by_word)
    return _encoders[key]


def _chunks(lengths: list[int]) -> Iterator[range]:
    """Ranges of rows with about `CHUNK` bytes each."""
    first = size = 0
    for i, length in enumerate(lengths):
        if size and size + length > CHUNK:
            yield range(first, i)
            first, size = i, 0
        size += length
    if first < len(lengths):
        yield range(first, len(lengths))


def write(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int,
    by_word: bool = False,
    layout: Layout = Layout(),
    keep: tuple[str, ...] = (),
    text: str = "text",
    doc_id: str = "doc_id",
) -> None:
    """Write the ids of every document, each closed by ``end_id``, below ``path``.

    ``vocabulary`` is the JSON of a tokenizer, sent to every task (a few MB). ``by_word`` holds for
    vocabularies that drop white space and never join letters across it. ``keep`` names columns to store.
    """
    spark = docs.sparkSession
    ship(spark)
    files = layout.files or min(partitions_for(spark), MOST_FILES)
    if not 1 <= files <= MOST_FILES:
        raise ValueError(f"files must be between 1 and {MOST_FILES}")
    options = layout.options()
    meta = [F.struct(*[F.col(quoted(c)) for c in keep]).alias("meta")] if keep else []
    rows = docs.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), text_of(text).alias("text"), *meta)
    # The last key keeps a doc_id that very many rows share from being one file.
    rows = rows.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = ["doc_id", "hash", "row"]
    dealt = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
    dealt = dealt.select(F.spark_partition_id().alias("part"), "doc_id", *(["meta"] if keep else []), "text")
    shared = spark.sparkContext.broadcast(vocabulary)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, start = _encoder(shared.value, by_word), 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            given = batch.drop_columns(["text"])
            for part in _chunks(pc.binary_length(texts).to_pylist()):
                ids = [x + end for x in encoder.encode(texts.slice(part.start, len(part)).to_pylist())]
                counts = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                ends = np.cumsum(counts)
                places = np.concatenate(([0], ends)).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(places), values)
                columns = given.slice(part.start, len(part)).columns
                names = [*given.schema.names, "start", "n_tokens", "ids"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(start + ends - counts), pa.array(counts), lists], names)
                start += int(ends[-1])

    schema = dealt.drop("text").schema.add("start", "long").add("n_tokens", "long").add("ids", T.ArrayType(T.IntegerType()))
    offsets = storage.join(path, "offsets")
    storage.remove(spark, offsets)
    dealt.mapInArrow(run, schema).write.mode("overwrite").options(**options).parquet(storage.join(path, "data"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    sums = _data(spark, path).groupBy("part").agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("ids"))
    base = F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base")
    sums.select("part", "rows", "ids", base).coalesce(1).write.mode("overwrite").parquet(offsets)


def _data(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(storage.join(path, "data"))


def read(spark: SparkSession, path: str, where: Column | str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids and, if kept, meta); ``start`` counts the ids of all documents before.

    ``where`` is a filter on stored columns; on doc_id it reads the pages that may hold such rows. Columns
    that are not used further on are not read.
    """
    rows = _data(spark, path)
    rows = rows if where is None else rows.where(where)
    base = F.broadcast(spark.read.parquet(storage.join(path, "offsets")).select("part", "base"))  # MOST_FILES rows at most
    start = (F.col("start") + F.col("base")).alias("start")
    kept = ["meta"] if "meta" in rows.columns else []
    return rows.join(base, "part").select("doc_id", start, "n_tokens", "ids", *kept)


def digests(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows of ``read``."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            values, places = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(places[:-1], places[1:])]
            columns = [batch.column(c) for c in ("doc_id", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = rows.select("doc_id", "start", "n_tokens", "ids")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
