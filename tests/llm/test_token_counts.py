import numpy as np
import pytest
from cases import SCHEMA, awkward, prose

from clipmill.llm import token_counts as t

pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return t.read_vocabulary()


def brute(encoder, text, spans, rule):
    """Each token allocated on its own."""
    data, borders = text.encode(), encoder.borders(text)
    spans = [(len(text[:a].encode()), len(text[:b].encode())) for a, b in spans]
    counts = [0.0] * len(spans)
    for x, y in zip(borders[:-1], borders[1:]):
        if rule == "share":
            for i, (a, b) in enumerate(spans):
                counts[i] += max(0, min(b, y) - max(a, x)) / (y - x)
        elif rule == "first":
            for i, (a, b) in enumerate(spans):
                counts[i] += a <= x < b
        else:
            inside = [max(0, min(b, y) - max(a, x)) for a, b in spans]
            if max(inside) > 0:
                counts[int(np.argmax(inside))] += 1
    assert borders[-1] == len(data)
    return counts


@pytest.mark.parametrize("rule", t.RULES)
def test_lines_equal_brute_force(spark, ranks, rule):
    texts = {1: "One line.\nTwo  lines\n\n\nthe end ", 2: "é漢字😀\n" + prose(40, 1), 3: "x", 4: prose(300, 2).replace(" ", "\n", 50)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {i: [] for i in texts}
    for r in t.attribute(docs, ranks, rule).collect():
        got[r.doc_id].append(r)
    encoder = t.Encoder(ranks)
    for i, text in texts.items():
        rows = sorted(got[i], key=lambda r: int(r.section))
        spans, at = [], 0
        for line in text.split("\n"):
            spans.append((at, min(at + len(line) + 1, len(text))))
            at += len(line) + 1
        assert [(r.start, r.end) for r in rows] == spans
        assert [r.n_tokens for r in rows] == pytest.approx(brute(encoder, text, spans, rule))
        assert sum(r.n_tokens for r in rows) == pytest.approx(len(encoder.borders(text)) - 1)


def test_tokens_of_an_encoding_are_lossless(ranks):
    encoder = t.Encoder(ranks)
    for text in ("Hello world", "  spaced   out\n\n", "naïve 漢字 😀", ""):
        assert encoder.encoding.decode(encoder.encoding.encode_ordinary(text)) == text
        assert encoder.borders(text)[-1] == len(text.encode())


def test_crossing_tokens():
    borders = np.array([0, 3, 6, 9])
    starts, ends = np.array([0, 1, 3, 4, 4, 5]), np.array([9, 2, 6, 8, 4, 9])
    assert t.crossing(borders, starts, ends).tolist() == [0, 1, 0, 2, 0, 1]


def test_given_sections_and_awkward_rows(spark, ranks):
    spans = [("all", 0, 10_000_000), ("none", 4, 4), ("outside", 9_999_999, 10_000_000), (None, None, None)]
    schema = SCHEMA + ", parts array<struct<name string, start int, `end` int>>, section string"
    docs = spark.createDataFrame([(*r, spans, "x") for r in awkward()] + [(9, "abc", None, None, None, None, None)], schema)
    got = t.attribute(docs, ranks, "first", sections="parts").collect()
    assert len(got) == 4 * len(awkward())
    encoder = t.Encoder(ranks)
    texts = {r[0]: r[1] or "" for r in awkward()}
    for r in got:
        assert r.n_tokens == (len(encoder.borders(texts[r.doc_id])) - 1 if r.section == "all" else 0)
    assert t.attribute(docs.where("doc_id in (1, 2)"), ranks).count() == 0
    with pytest.raises(ValueError):
        t.attribute(docs, ranks, "last")
