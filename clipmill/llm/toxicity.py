"""Toxicity by subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (3 to 5, with word borders) and itself, each hashed to an
embedding; their average goes through a linear softmax with two classes. A misspelt or inflected word
no label has shown shares most n-grams with one that labels have, and so most of its vector.

Labels belong to documents, not words: a document is toxic if any of its words is, so its probability
is 1 - prod(1 - p(word)) over its distinct words, and the loss of that probability trains embeddings
and softmax together (Adam, full batches). A few insults in a long clean-looking text are not diluted.

The more words a text has, the likelier a harmless one looks like an insult. So beyond `Fit.words`
distinct words the odds of the document are divided by (words / `Fit.words`) ** s. The power s is fitted
out of sample: each half of the labelled texts is scored by a model of the other half, and a logistic
fit with -log(1 - p) and the log of the number of words as inputs says how much the one weighs in units
of the other. It is at least 1, as small chances add up in proportion to the words. A text's score so does not rise with its length; a few certain insults outweigh it.

Training takes a bounded sample: `Fit.per_class` labelled texts a class, those with the smallest hash
of their id; of these, texts over `Fit.most_bytes` bytes are left out. Scoring reads whole texts in one
pass; each worker scores a distinct word once.

Defined results: null and empty texts, and texts without letters, score 0. Rows with a null label teach
nothing; with a class missing from the sample every score is the share of toxic labels, 0 without
labels. Of several texts of one id the one with the least hash teaches. Repeated rows get equal scores;
clashing input columns are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmill.llm import shingles
from clipmill.llm.common import labelled_texts, others, quoted, scored
from clipmill.shipping import ship

ADDED = ("score", "predicted")
_ROLL = np.uint64(0xD1342543DE82EF95)
_LETTERS = re.compile(r"[^\W\d_]+")
#: Distinct words a worker remembers before it starts anew.
MEMORY = 1 << 20


@dataclass(frozen=True)
class Fit:
    per_class: int = 600
    most_bytes: int = 1 << 16
    buckets: int = 1 << 15
    size: int = 8
    rounds: int = 50
    rate: float = 0.1
    decay: float = 1e-5
    threshold: float = 0.7
    seed: int = 11
    words: int = 64


def subwords(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashed subwords of all words, word after word, and how many each word has.

    A word with its borders, "<word>", gives its runs of 3, 4 and 5 characters and itself.
    """
    lengths = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.cumsum(lengths) - lengths
    left = np.repeat(starts + lengths, lengths) - np.arange(len(codes))  # characters to the word's end
    rolled, hashes, owners = np.zeros(len(codes), dtype=np.uint64), [], []
    word_of = np.repeat(np.arange(len(words)), lengths)
    for n in range(1, 6):
        rolled[: len(codes) - n + 1] = rolled[: len(codes) - n + 1] * _ROLL + codes[n - 1 :]
        if n >= 3:
            at = np.flatnonzero(left >= n)
            hashes.append(shingles.mixed(rolled[at] + np.uint64(n)))
            owners.append(word_of[at])
    whole = np.zeros(len(words), dtype=np.uint64)
    for k in range(int(lengths.max(initial=0))):
        at = np.flatnonzero(lengths > k)
        whole[at] = whole[at] * _ROLL + codes[starts[at] + k]
    hashes.append(shingles.mixed(whole))
    owners.append(np.arange(len(words)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    flat = (np.concatenate(hashes)[order] % np.uint64(buckets)).astype(np.int64)
    return flat, np.bincount(owner, minlength=len(words))


def distinct_words(text: str | None) -> set[str]:
    return set(_LETTERS.findall((text or "").lower()))


class Model:
    """Embeddings and softmax weights; `words` maps a word to the log of its clean probability."""

    def __init__(self, toxic: list[str], clean: list[str], fit: Fit, by_length: bool = True):
        self.fit, self.weights, self.known, self.power = fit, None, {}, 1.0 if by_length else 0.0
        labels = len(toxic) + len(clean)
        self.base = len(toxic) / labels if labels else 0.0
        if toxic and clean:
            self._train([distinct_words(t) for t in toxic + clean], np.array([1.0] * len(toxic) + [0.0] * len(clean)))
            if by_length and min(len(toxic), len(clean)) >= 4:
                self.power = self._power(toxic, clean)

    def _power(self, toxic: list[str], clean: list[str]) -> float:
        """How the odds fall with the number of words, from halves that are scored by each other's model."""
        rng = np.random.default_rng(self.fit.seed)
        toxic, clean = ([texts[i] for i in rng.permutation(len(texts))] for texts in (toxic, clean))
        p, lengths, y = [], [], []
        for k in (0, 1):
            half = Model(toxic[1 - k :: 2], clean[1 - k :: 2], self.fit, by_length=False)
            if half.weights is None:
                return 1.0
            texts = toxic[k::2] + clean[k::2]
            p += half.scores(texts).tolist()
            lengths += [self._excess(len(distinct_words(t))) for t in texts]
            y += [1.0] * len(toxic[k::2]) + [0.0] * len(clean[k::2])
        y = np.array(y)
        # -log(1 - p) is the log odds of a likely toxic text; of the others, all that counts is that they are not
        x = np.column_stack((np.ones(len(y)), -np.log1p(-np.minimum(p, 1 - 1e-5)), lengths))
        balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        ridge, w = 1e-3 * len(y) * np.diag([0.0, 1.0, 1.0]), np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w = w + np.linalg.solve((x * (balance * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (balance * (y - p)) - ridge @ w)
        return max(1.0, float(-w[2] / w[1])) if w[1] > 0 else 1.0

    def _excess(self, words: int) -> float:
        return max(0.0, math.log(max(words, 1) / self.fit.words))

    def _score(self, words: set[str]) -> float:
        mass = math.fsum(map(self.known.__getitem__, words))  # -log of the probability that all are clean
        less = self.power * self._excess(len(words))  # 0 for texts of few words
        if not less:
            return -math.expm1(-mass)
        odds = math.expm1(min(mass, 500.0)) * math.exp(-less)
        return odds / (1 + odds)

    def _train(self, docs: list[set[str]], y: np.ndarray) -> None:
        fit, rng = self.fit, np.random.default_rng(self.fit.seed)
        vocabulary = {w: i for i, w in enumerate(sorted(set().union(*docs)))}
        keep = [k for k, d in enumerate(docs) if d]
        if not keep:
            return
        y = y[keep]
        members = [np.array(sorted(vocabulary[w] for w in docs[k])) for k in keep]
        word_of = np.concatenate(members)
        sizes = np.array([len(m) for m in members])
        doc_of = np.repeat(np.arange(len(members)), sizes)
        flat, counts = subwords(list(vocabulary), fit.buckets)
        owner, first = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts) - counts
        weights = {
            "e": rng.normal(0, 0.1, (fit.buckets, fit.size)),
            "u": rng.normal(0, 0.5, (fit.size, 2)),
            "b": np.array([6.0, 0.0]),
        }
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
        balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        for step in range(1, fit.rounds + 1):
            vectors = np.add.reduceat(weights["e"][flat], first) / counts[:, None]
            logit = vectors @ (weights["u"][:, 1] - weights["u"][:, 0]) + weights["b"][1] - weights["b"][0]
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            mass = np.bincount(doc_of, np.logaddexp(0, logit)[word_of], len(members))  # -log prod(1 - p)
            toxic = np.clip(-np.expm1(-mass), 1e-6, 1)
            # d loss / d mass: 1 for clean documents, -(1 - P) / P for toxic ones
            slope = balance * np.where(y == 1, -np.exp(-mass) / toxic, 1.0) / len(y)
            by_word = np.bincount(word_of, slope[doc_of], len(counts)) * p
            gain = vectors.T @ by_word
            spread = (by_word / counts)[:, None] * (weights["u"][:, 1] - weights["u"][:, 0])
            change = {
                "e": np.column_stack([np.bincount(flat, spread[owner, k], fit.buckets) for k in range(fit.size)])
                + fit.decay * weights["e"],
                "u": np.column_stack((-gain, gain)) + fit.decay * weights["u"],
                "b": np.array([-by_word.sum(), by_word.sum()]),
            }
            for name, g in change.items():
                m, v = moment[name]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                weights[name] -= fit.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weights = {k: v.astype(np.float32) for k, v in weights.items()}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def _learn(self, words: list[str]) -> None:
        """Put -log of the probability that a word is clean into `known`, for each of ``words``."""
        if "t" not in self.weights:  # the softmax is linear, so it applies to each subword
            u = self.weights["u"].astype(np.float64)
            self.weights["t"] = self.weights["e"] @ (u[:, 1] - u[:, 0])
        flat, counts = subwords(words, self.fit.buckets)
        logit = np.add.reduceat(self.weights["t"][flat], np.cumsum(counts) - counts) / counts
        logit += float(self.weights["b"][1]) - float(self.weights["b"][0])
        self.known.update(zip(words, np.logaddexp(0, logit).tolist()))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.base)
        out = np.empty(len(texts))
        known = self.known
        for part, _ in shingles.chunks(texts):
            docs = [distinct_words(t) for t in texts[part]]
            if len(known) > MEMORY:
                known.clear()
            new = sorted(set().union(*docs) - known.keys())
            if new:
                self._learn(new)
            out[part] = [self._score(d) for d in docs]
        return out


def train(
    docs: DataFrame,
    labels: DataFrame,
    fit: Fit = Fit(),
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "toxic",
) -> Model:
    """The model of the labelled rows: ``labels`` (doc_id, label) with 1 for toxic and 0 for clean."""
    rows = labels.select(F.col(quoted(doc_id)).alias("i"), F.col(quoted(label)).alias("y")).where("i is not null")
    texts = docs.select(F.col(quoted(doc_id)).alias("i"), F.col(quoted(text)).alias("t"))
    texts = texts.where(F.octet_length("t").between(1, fit.most_bytes))
    sample: dict[int, list[str]] = {0: [], 1: []}
    for r in sorted(labelled_texts(texts, rows, fit.per_class).collect(), key=lambda r: r.i):
        sample[r.y].append(r.t)
    return Model(sample[1], sample[0], fit)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher is more toxic) and ``predicted`` (1 from the threshold on)."""
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
