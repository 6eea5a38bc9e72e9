"""Quality by compression: zstandard dictionaries of good and of bad labelled text.

A text is compressed with each dictionary, in pieces of `Fit.piece` bytes so that the dictionary weighs
the same at any length. Text like the good sample comes out smaller with the
good dictionary, so the difference of the two sizes, divided by the smaller, tells the classes apart;
how far the text compresses at all is read off the same sizes. Both numbers become a
probability by a logistic fit (Newton steps in numpy) on labelled texts that no dictionary has seen, moved to the share
of good texts among all labels.

The dictionaries and the fit use a bounded sample: `Fit.per_class` labelled texts a class, those with
the smallest hash of their id; of these, texts over `Fit.most_bytes` bytes are left out. The fit reads
them whole. A dictionary holds up to `Fit.text_bytes` = 512 bytes of each, however many there are: a
shorter text whole, of a longer one `Fit.windows` = 4 windows, one at a random place (seeded by the
text) of each quarter. So it has 1 MB at most. Scoring reads whole texts, in one pass without a shuffle.

Defined results: null and empty texts have both numbers 0 and get the fitted base score. Rows with a
null label teach nothing. With a class missing from the sample every score is the share of good
labels, 0.5 without labels. Of several texts of one id the one with the least hash teaches. Repeated
rows get equal scores; clashing input columns are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmill.llm.common import labelled_texts, others, quoted, scored
from clipmill.shipping import ship

ADDED = ("score", "predicted")


@dataclass(frozen=True)
class Fit:
    per_class: int = 2000
    most_bytes: int = 1 << 16
    text_bytes: int = 512
    windows: int = 4
    level: int = 6
    piece: int = 500
    threshold: float = 0.7
    ridge: float = 1e-3


class Model:
    """Two dictionaries and the weights of the logistic fit."""

    def __init__(self, good: list[bytes], bad: list[bytes], fit: Fit, share: float | None = None):
        """``share`` of all labels are good; the sample's own share without it."""
        self.fit, self.weights = fit, None
        labels = len(good) + len(bad)
        self.base = share if share is not None else len(good) / labels if labels else 0.5
        if min(len(good), len(bad)) < 4:
            return
        x, y = [], []
        for k in (0, 1):  # each half is measured with dictionaries of the other
            self._use(good[1 - k :: 2], bad[1 - k :: 2])
            x += [self.numbers(t) for t in good[k::2] + bad[k::2]]
            y += [1.0] * len(good[k::2]) + [0.0] * len(bad[k::2])
        x, y = np.array(x), np.array(y)
        self._use(good, bad)
        self.center, self.scale = x.mean(0), x.std(0) + 1e-9
        self.weights = self._logistic(self._inputs(x), y)
        # The sample takes as many of either class; the score is for the classes as they come.
        sampled = np.log(len(good) / len(bad))
        self.weights[0] += np.log(self.base / (1 - self.base)) - sampled if 0 < self.base < 1 else 0.0

    def _use(self, good: list[bytes], bad: list[bytes]) -> None:
        self.dictionaries = [self._dictionary(good), self._dictionary(bad)]
        self.__dict__.pop("_ready", None)

    def _dictionary(self, texts: list[bytes]) -> bytes:
        """The windows of all texts as dictionary content."""
        return b"".join(part for t in texts for part in self._windows(t))

    def _windows(self, text: bytes) -> list[bytes]:
        """At most `Fit.text_bytes` of ``text``, the same in whatever sample: spread over all of it, or all of it."""
        if len(text) <= self.fit.text_bytes:
            return [text]
        n, size = self.fit.windows, self.fit.text_bytes // self.fit.windows
        step = len(text) / n
        places = np.random.default_rng(zlib.crc32(text)).random(n)
        return [text[(at := int(k * step + x * (step - size))) : at + size] for k, x in enumerate(places)]

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.scale
        return np.column_stack((np.ones(len(z)), z, z[:, 1] ** 2))

    def _logistic(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        w = np.zeros(x.shape[1])
        ridge = self.fit.ridge * len(y) * np.eye(len(w))
        ridge[0, 0] = 0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
        return w

    def _compressors(self) -> list[zstandard.ZstdCompressor]:
        if not hasattr(self, "_ready"):
            self._ready = []
            for content in self.dictionaries:
                data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                data.precompute_compress(level=self.fit.level)
                self._ready.append(
                    zstandard.ZstdCompressor(dict_data=data, write_checksum=False, write_content_size=False)
                )
        return self._ready

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_ready"}

    def numbers(self, text: bytes) -> tuple[float, float]:
        """Difference of the compressed sizes over the smaller one, and the compression in logs."""
        if not text:
            return 0.0, 0.0
        pieces = [text[i : i + self.fit.piece] for i in range(0, len(text), self.fit.piece)]
        good, bad = (sum(len(c.compress(p)) for p in pieces) for c in self._compressors())
        return (bad - good) / min(good, bad), float(np.log(len(text) / min(good, bad)))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.base)
        if not texts:
            return np.empty(0)
        x = np.array([self.numbers((t or "").encode("utf-8", "surrogatepass")) for t in texts])
        return 1 / (1 + np.exp(-np.clip((self._inputs(x) * self.weights).sum(1), -30, 30)))


def train(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> Model:
    """The model of the labelled rows: ``labels`` (doc_id, label) with 1 for good and 0 for bad."""
    rows = labels.select(F.col(quoted(doc_id)).alias("i"), F.col(quoted(label)).alias("y")).where("i is not null")
    texts = docs.select(F.col(quoted(doc_id)).alias("i"), F.col(quoted(text)).alias("t"))
    texts = texts.where(F.octet_length("t").between(1, fit.most_bytes))
    sample: dict[int, list[bytes]] = {0: [], 1: []}
    # in the order of the hash, so that halves of the sample do not follow the ids
    for r in sorted(labelled_texts(texts, rows, fit.per_class).collect(), key=lambda r: (r.x, r.i)):
        sample[r.y].append(r.t.encode("utf-8", "surrogatepass"))
    counts = dict(rows.where("y in (0, 1)").groupBy("y").agg(F.count("*").alias("n")).collect())
    labels = sum(counts.values())
    return Model(sample[1], sample[0], fit, counts.get(1, 0) / labels if labels else None)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher is better) and ``predicted`` (1 from the threshold on)."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(*[F.col(quoted(c)) for c in others(docs, *ADDED)])
    at, shared = rows.columns.index(text), spark.sparkContext.broadcast(model)
    threshold = model.fit.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores(batch.column(at).to_pylist())
            marks = pa.array((scores >= threshold).astype(np.int32))
            names = [*batch.schema.names, *ADDED]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), marks], names=names)

    return rows.mapInArrow(run, scored(rows))
