"""Main text of web pages by a recurrent labeller of blocks, in numpy.

A page is its sequence of text blocks (`html_blocks`). Each block is read as a vector: the hashed words
of its tag path and of its text, each an average of learned embeddings, and a few numbers (length, share
of links, place, punctuation). A bidirectional LSTM runs over the whole sequence, so every block is
labelled main text or not knowing the page before and after it.

The labeller is trained here, on a bounded sample of `Fit.pages` different pages of at most
`Fit.most_bytes` (those with the smallest hash). A page with over `Fit.most_blocks` blocks teaches those
around the beginning of its main text; extraction reads whole pages.
Labels come from the pages' own semantic markup: blocks inside ``article`` or ``main`` that no
boilerplate element holds are main text. So that the labeller does not depend on that markup, each
sampled page is also rebuilt in other layouts: its main text in other containers, blocks of other pages
as menus, headers, sidebars, notices, adverts, forms and comments around and inside, path words dropped
at random, and some paragraphs cut to a word or two, so that shortness alone decides nothing. Pages without semantic markup teach nothing by themselves.

Scoring is one pass over the pages; pages of similar length run through the LSTM together.

Only scripts, styles and templates are dropped unread. Text in buttons, formulas, objects and the like
belongs to the block around it; a block that is a button, a choice or a text field alone says so in its path.

Defined results: null and empty pages have empty text. A page without a labelled block has empty text.
Without a page to learn from, blocks inside ``article`` or ``main`` are taken. Truncated pages are read
to their end. Repeated rows get equal texts; clashing input columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipmill.llm.common import others, quoted
from clipmill.llm.html_blocks import Block, blocks
from clipmill.shipping import ship

ADDED = ("text", "n_chars")
NUMBERS = 7

_MAIN = {"article", "main"}
_ASIDE = {"nav", "header", "footer", "aside", "form", "head", "title", "menu", "dialog", "button"}

#: Layouts that sampled pages are rebuilt in: names that pages commonly give to such containers.
_CONTENT = (
    "article", "main", "div .content", "div .article .body", "div .post", "div .entry .content", "section .story",
    "div .main", "div .page .text", "main article", "div .main article", "div .post .content article",
)
_BOILERPLATE = (
    ("menu", ("nav ul li", "nav", "div .menu ul li", "div .navbar ul li", "ul .nav li", "div .breadcrumb", "div .navigation", "menu li", "div .tabs ul li", "div .pagination")),
    ("header", ("header", "div .header", "header div .logo", "div .top .bar", "div .masthead", "header nav ul li", "div .site .header", "div .banner")),
    ("footer", ("footer", "div .footer", "footer p", "div .copyright", "footer ul li", "div .legal", "div .site .footer")),
    ("sidebar", ("aside", "aside div", "aside ul li", "div .sidebar", "div .sidebar ul li", "div .widget", "div .related ul li", "div .recommended", "section .related", "div .trending", "div .tags", "aside p", "div .rail")),
    ("notice", ("div .cookie .notice", "div .cookie .banner p", "div .notice", "div .alert", "div .consent", "div .gdpr", "div .popup", "div .modal", "div .privacy", "div .message", "div .dialog", "section .notice p")),
    ("advert", ("div .ad", "div .ads", "div .advert", "div .advertisement", "div .sponsored", "aside .ad", "div .promo", "div .banner .ad", "ins .adsbygoogle", "div .sponsor p", "section .promotion")),
    ("form", ("form", "form label", "form p", "div .newsletter form", "div .subscribe", "div .signup", "form .search", "div .login form", "form fieldset", "div .newsletter p")),
    ("comments", ("div .comments", "div .comments div .comment p", "section .comments p", "ul .comments li", "ol .comment .list li", "div .comment .body", "div .reply p", "div .disqus", "section .comments article p", "div .responses", "div .user .comment", "section .comments h2", "div .reviews p")),
    ("share", ("div .share", "div .social", "ul .share li", "div .byline", "div .meta", "div .toolbar", "div .author .bio")),
)


@dataclass(frozen=True)
class Fit:
    pages: int = 160
    most_bytes: int = 1 << 16
    most_blocks: int = 120
    layouts: int = 6
    buckets: int = 2048
    path_size: int = 16
    word_size: int = 8
    hidden: int = 16
    rounds: int = 5
    batch: int = 32
    rate: float = 0.01
    seed: int = 3


def is_main(path: tuple[str, ...]) -> bool:
    """What semantic markup says of a block."""
    return bool(_MAIN & set(path)) and not _ASIDE & set(path)


def _hash(word: str, buckets: int) -> int:
    return xxhash.xxh32_intdigest(word) % buckets


class Features:
    """The vectors' inputs: path and word buckets with their blocks, and numbers."""

    def __init__(self, fit: Fit):
        self.fit, self.known = fit, {}

    def _bucket(self, word: str) -> int:
        if word not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = _hash(word, self.fit.buckets)
        return self.known[word]

    def page(self, found: list[Block], drop: np.random.Generator | None = None) -> tuple[list, list, np.ndarray]:
        """Bucket lists of paths and of words, and numbers, by block."""
        paths, words = [], []
        numbers = np.zeros((len(found), NUMBERS))
        for i, b in enumerate(found):
            path = [x for x in b.path if drop is None or drop.random() > 0.1]
            deep = [f"<{x}" for x in path[-3:]]
            paths.append([self._bucket(x) for x in (*path, *deep)] or [0])
            words.append([self._bucket(f"w{w}") for w in set(b.text.lower().split())] or [0])
            n = len(b.text)
            numbers[i] = (
                min(np.log1p(n) / 7, 1.5),
                b.linked / n,
                i / len(found),
                1.0 if b.text[-1] in ".!?…:;\"'" else 0.0,
                sum(b.text.count(c) for c in ".,;") * 10 / (n + 10),
                min(len(b.path) / 10, 2),
                1.0,
            )
        return paths, words, numbers


def _pooled(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(x) for x in lists])
    return np.concatenate([np.array(x) for x in lists]), counts


class Labeller:
    """Embeddings, two LSTMs and the output layer."""

    def __init__(self, fit: Fit):
        self.fit, rng = fit, np.random.default_rng(fit.seed)
        d, h = fit.path_size + fit.word_size + NUMBERS, fit.hidden
        self.w = {"p": rng.normal(0, 0.3, (fit.buckets, fit.path_size)), "t": rng.normal(0, 0.1, (fit.buckets, fit.word_size))}
        for side in "fb":
            self.w[f"x{side}"] = rng.normal(0, 1 / np.sqrt(d), (d, 4 * h))
            self.w[f"h{side}"] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))
            self.w[f"c{side}"] = np.repeat([0.0, 1.0, 0.0, 0.0], h)  # gates: in, forget, out, new
        self.w["o"], self.w["d"], self.w["k"] = rng.normal(0, 0.1, 2 * h), rng.normal(0, 0.1, d), np.zeros(1)
        self.trained = False

    def _inputs(self, pages: list[tuple]) -> tuple[np.ndarray, np.ndarray, list]:
        """Padded inputs (time, page, d), the mask, and what the embeddings' gradients need."""
        sizes = np.array([len(p[2]) for p in pages])
        steps = int(sizes.max())
        where = np.concatenate([np.arange(s) * len(pages) + i for i, s in enumerate(sizes)])
        back = []
        parts = []
        for k, name in ((0, "p"), (1, "t")):
            flat, counts = _pooled([x for p in pages for x in p[k]])
            first = np.cumsum(counts) - counts
            parts.append(np.add.reduceat(self.w[name][flat], first) / counts[:, None])
            back.append((name, flat, counts))
        rows = np.concatenate([*parts, np.concatenate([p[2] for p in pages])], axis=1)
        x = np.zeros((steps * len(pages), rows.shape[1]))
        x[where] = rows
        mask = np.zeros(steps * len(pages), dtype=bool)
        mask[where] = True
        return x.reshape(steps, len(pages), -1), mask.reshape(steps, len(pages)), [where, back]

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        """The states of one direction; padding keeps the state as it is."""
        h = self.fit.hidden
        order = range(len(x)) if side == "f" else range(len(x) - 1, -1, -1)
        inputs = x @ self.w[f"x{side}"] + self.w[f"c{side}"]
        state, cell = np.zeros((x.shape[1], h)), np.zeros((x.shape[1], h))
        out, tape = np.empty((*x.shape[:2], h)), []
        for t in order:
            z = inputs[t] + state @ self.w[f"h{side}"]
            gates = 1 / (1 + np.exp(-z[:, : 3 * h]))
            new = np.tanh(z[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            next_cell = f * cell + i * new
            squashed = np.tanh(next_cell)
            m = mask[t][:, None]
            tape.append((t, state, cell, i, f, o, new, squashed, m))
            cell = np.where(m, next_cell, cell)
            state = np.where(m, o * squashed, state)
            out[t] = state
        return out, tape

    def _back(self, x: np.ndarray, tape: list, side: str, grad: np.ndarray, change: dict) -> np.ndarray:
        h = self.fit.hidden
        dz_all = np.zeros((*x.shape[:2], 4 * h))
        ds, dc = np.zeros((x.shape[1], h)), np.zeros((x.shape[1], h))
        for t, state, cell, i, f, o, new, squashed, m in reversed(tape):
            ds = ds + grad[t]
            own, kept = np.where(m, ds, 0), np.where(m, 0, ds)
            c = np.where(m, dc, 0) + own * o * (1 - squashed**2)
            dz = np.concatenate((c * new * i * (1 - i), c * cell * f * (1 - f), own * squashed * o * (1 - o), c * i * (1 - new**2)), 1)
            dz_all[t] = dz
            change[f"h{side}"] += state.T @ dz
            ds = kept + dz @ self.w[f"h{side}"].T
            dc = np.where(m, c * f, dc)
        flat = dz_all.reshape(-1, 4 * h)
        change[f"x{side}"] += x.reshape(-1, x.shape[2]).T @ flat
        change[f"c{side}"] += flat.sum(0)
        return (flat @ self.w[f"x{side}"].T).reshape(x.shape)

    def logits(self, pages: list[tuple]) -> list[np.ndarray]:
        """The log odds of main text, by page and block."""
        x, mask, _ = self._inputs(pages)
        (f, _), (b, _) = self._run(x, mask, "f"), self._run(x, mask, "b")
        z = np.concatenate((f, b), 2) @ self.w["o"] + x @ self.w["d"] + self.w["k"]
        return [z[: len(p[2]), i] for i, p in enumerate(pages)]

    def train(self, pages: list[tuple], labels: list[np.ndarray]) -> None:
        """Adam over shuffled batches of pages of similar length."""
        fit, rng = self.fit, np.random.default_rng(self.fit.seed + 1)
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        order = sorted(range(len(pages)), key=lambda i: len(labels[i]))
        batches = [order[i : i + fit.batch] for i in range(0, len(order), fit.batch)]
        step = 0
        for _ in range(fit.rounds):
            for k in rng.permutation(len(batches)):
                step += 1
                some = [pages[i] for i in batches[k]]
                y = np.zeros((max(len(labels[i]) for i in batches[k]), len(some)))
                for j, i in enumerate(batches[k]):
                    y[: len(labels[i]), j] = labels[i]
                self._step(some, y, moment, step)
        self.trained = True

    def _step(self, pages: list[tuple], y: np.ndarray, moment: dict, step: int) -> None:
        x, mask, (where, back) = self._inputs(pages)
        (f, tape_f), (b, tape_b) = self._run(x, mask, "f"), self._run(x, mask, "b")
        both = np.concatenate((f, b), 2)
        p = 1 / (1 + np.exp(-np.clip(both @ self.w["o"] + x @ self.w["d"] + self.w["k"], -30, 30)))
        error = np.where(mask, p - y, 0) / mask.sum()
        change = {k: np.zeros_like(v) for k, v in self.w.items()}
        change["o"] = np.tensordot(error, both, 2)
        change["d"] = np.tensordot(error, x, 2)
        change["k"][:] = error.sum()
        grad = error[:, :, None] * self.w["o"]
        h = self.fit.hidden
        dx = error[:, :, None] * self.w["d"] + self._back(x, tape_f, "f", grad[:, :, :h], change)
        dx = dx + self._back(x, tape_b, "b", grad[:, :, h:], change)
        rows, at = dx.reshape(-1, x.shape[2])[where], 0
        for name, flat, counts in back:
            size = self.w[name].shape[1]
            spread = np.repeat(rows[:, at : at + size] / counts[:, None], counts, axis=0)
            for c in range(size):
                change[name][:, c] = np.bincount(flat, spread[:, c], self.fit.buckets)
            at += size
        for k, g in change.items():
            m, v = moment[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            self.w[k] -= self.fit.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def _layouts(pages: list[list[Block]], fit: Fit) -> Iterator[tuple[list[Block], np.ndarray]]:
    """Labelled sequences: each page as it is, and rebuilt in other layouts."""
    rng = np.random.default_rng(fit.seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    texts = [b.text for page in pages for b in page]

    def cut_short(b: Block) -> Block:
        """Some paragraphs are a word or two: their place says that they are main text, not their length."""
        if rng.random() > 0.3:
            return b
        text = " ".join(pick(texts).split()[: int(rng.integers(1, 4))]).rstrip(".,;")[:40] or b.text
        return Block(text + pick((".", ".", "!", "")), b.path, 0)

    for page in pages:
        labels = [is_main(b.path) for b in page]
        yield page, np.array(labels, dtype=float)
        yield [cut_short(b) if y else b for b, y in zip(page, labels)], np.array(labels, dtype=float)
        body = [b for b, y in zip(page, labels) if y]
        for _ in range(fit.layouts if body else 0):
            container = ["html", "body", *pick((("",), ("div .wrapper",), ("div .container",), ("div",)))[0].split()]
            inside = container + pick(_CONTENT).split()
            main = [Block(b.text, (*inside, pick(("p", "p", "p", b.path[-1], "h2", "li", "blockquote")) if k else "h1"), b.linked) for k, b in enumerate(body)]
            sequence = [(cut_short(b), 1.0) for b in main]
            for kind, paths in _BOILERPLATE:
                if rng.random() < 0.45:
                    continue
                path = pick(paths).split()
                within = rng.random() < 0.5 and kind not in ("header", "footer")
                lead = inside if within else container
                run = []
                for _ in range(int(rng.integers(1, 6))):
                    text = pick(texts)
                    if kind in ("menu", "share", "form") or rng.random() < 0.4:
                        text = " ".join(text.split()[: int(rng.integers(1, 5))])
                    linked = len(text) if kind == "menu" or rng.random() < 0.3 else 0
                    tail = [pick(("p", "div", "span", "h3", "a"))] if rng.random() < 0.4 else []
                    run.append((Block(text, tuple([*lead, *path, *(x for x in tail if x not in ("a", "span"))]), linked), 0.0))
                if within:
                    at = int(rng.integers(0, len(sequence) + 1))
                else:
                    at = 0 if kind in ("menu", "header") or rng.random() < 0.4 else len(sequence)
                sequence[at:at] = run
            yield [b for b, _ in sequence], np.array([y for _, y in sequence])


def _window(page: list[Block], size: int) -> list[Block]:
    """At most ``size`` blocks of a page to learn from, half of them before its main text begins if there are as many."""
    first = next((i for i, b in enumerate(page) if is_main(b.path)), 0)
    start = max(0, min(first - size // 2, len(page) - size))
    return page[start : start + size]


def train(pages: DataFrame, fit: Fit = Fit(), html: str = "html") -> Labeller:
    """The labeller learned from a bounded sample of ``pages``."""
    content = F.col(quoted(html)).cast("string")
    sample = pages.select(content.alias("h"), F.xxhash64(content).alias("x")).where(F.octet_length("h").between(1, fit.most_bytes))
    # Hashes are ranked, not pages; each page chosen comes to the driver once, however often it occurs.
    chosen = [r.x for r in sample.select("x").distinct().orderBy("x").limit(fit.pages).collect()]
    rows = sample.where(F.col("x").isin(chosen)).groupBy("x").agg(F.min("h").alias("h")).collect() if chosen else []
    parsed = [_window(blocks(h), fit.most_blocks) for h in sorted(r.h for r in rows)]
    parsed = [p for p in parsed if any(is_main(b.path) for b in p)]
    labeller = Labeller(fit)
    if parsed:
        features, drop = Features(fit), np.random.default_rng(fit.seed + 2)
        inputs, labels = [], []
        for sequence, y in _layouts(parsed, fit):
            inputs.append(features.page(sequence, drop))
            labels.append(y)
        labeller.train(inputs, labels)
    return labeller


def texts_of(pages: list[str | None], labeller: Labeller, features: Features) -> list[str]:
    """The main text of each page."""
    parsed = [blocks(p) for p in pages]
    keep: list = [np.array([is_main(b.path) for b in p], dtype=bool) for p in parsed]
    if labeller.trained:
        order = sorted((i for i, p in enumerate(parsed) if p), key=lambda i: len(parsed[i]))
        while order:
            longest = len(parsed[order[-1]])
            some = [order.pop() for _ in range(min(len(order), max(1, 8192 // longest)))]
            for i, z in zip(some, labeller.logits([features.page(parsed[i]) for i in some])):
                keep[i] = z > 0
    return ["\n\n".join(b.text for b, y in zip(p, k) if y) for p, k in zip(parsed, keep)]


def extract(pages: DataFrame, labeller: Labeller, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` (the main text) and ``n_chars``."""
    spark = pages.sparkSession
    ship(spark)
    rows = pages.select(*[F.col(quoted(c)) for c in others(pages, *ADDED)])
    at, shared = rows.columns.index(html), spark.sparkContext.broadcast(labeller)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(shared.value.fit)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = texts_of(part.column(at).to_pylist(), shared.value, features)
                columns = [*part.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *ADDED])

    added = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *added]))
