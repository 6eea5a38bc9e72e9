import random
import sys
import time

import numpy as np
from cases import SCHEMA, awkward, prose

from clipmill.llm import decontaminate as d


def distance(a, b):
    """Fewest edits between a and any stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(text, n, rng):
    chars = list(text)
    for _ in range(n):
        at = rng.randrange(len(chars))
        chars[at : at + 1] = rng.choice([[], [chars[at], "x"], ["q"]])
    return "".join(chars)


def plain(text):
    return " ".join(text.lower().split())


def test_every_passage_within_budget_is_found(spark):
    rng, budget = random.Random(3), d.Budget()
    items = [(i, prose(12 + 3 * i, 100 + i).capitalize() + ".") for i in range(8)]
    rows, want = [], set()
    for k in range(120):
        i, text = items[k % 8]
        spoiled = edited(text, k // 8, rng).replace(" ", "\n ", 1)
        rows.append((k, f"{prose(rng.randint(0, 40), k)} {spoiled.upper() if k % 3 == 0 else spoiled} {prose(rng.randint(0, 40), -k)}"))
    for k, text in rows:
        for i, item in items:
            if distance(plain(item), plain(text)) <= budget.edits(len(plain(item))):
                want.add((k, i))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = d.find_passages(docs, bench, budget).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and 8 < len(want) < 120
    texts, passages = dict(rows), dict(items)
    for r in found:
        stretch = plain(texts[r.doc_id][r.start : r.end])
        assert distance(stretch, plain(passages[r.item_id])) <= r.edits + 2
        assert r.edits or stretch == plain(passages[r.item_id])
    blocks = d.find_passages(docs, bench, d.Budget(block_bytes=300)).collect()
    assert sorted(blocks) == sorted(found)
    kept = d.without_passages(docs, bench, budget)
    assert {r.doc_id for r in kept.collect()} == {k for k, _ in rows} - {k for k, _ in want} and kept.columns == docs.columns


def test_two_copies_in_one_text():
    text = prose(30, 5)
    passages = d.Passages([(9, text)], d.Budget())
    found = d.search(passages, [f"{prose(5, 6)} {text} {prose(20, 7)} {text}".encode(), b"", b"short"])
    assert [(r[0], r[1], r[4]) for r in found] == [(0, 9, 0), (0, 9, 0)] and found[0][3] < found[1][2]


def test_aligned_equals_full_table():
    rng = random.Random(8)
    for _ in range(40):
        a = prose(6, rng.random())
        b = f"{prose(2, rng.random())} {edited(a, rng.randint(0, 3), rng)} {prose(2, rng.random())}"
        got, _ = d.aligned(np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8), -len(a), len(a) + len(b) + 1, 99)
        assert got == distance(a, b)


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(*r, 1) for r in awkward()], SCHEMA + ", item_id long")
    bench = spark.createDataFrame([(1, prose(60, 3)), (1, prose(60, 3)), (2, None), (None, ""), (3, "yes")], "item_id long, text string")
    got = d.find_passages(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(5, 1)}
    kept = d.without_passages(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(awkward()) - 2
    assert d.find_passages(docs, bench.where("false")).count() == 0
    assert d.without_passages(docs.where("false"), bench).count() == 0


SPOKEN = {
    "fr": "l'été dernier, à l'opéra, élise a été gênée par une fenêtre fermée; où êtes-vous allés après, là-bas?",
    "de": "die größte straße führt über die brücke, wo süße äpfel und weiße öfen für außergewöhnliche gäste stehen",
    "ru": "съешь же ещё этих мягких французских булок, да выпей чаю, и приходи к нам на широкую улицу",
    "el": "ο πρώτος φίλος μας είναι ο γιώργος, ένας άνθρωπος της θάλασσας και των μεγάλων δρόμων της πόλης",
    "tr": "ışıl ışıl istanbul'da iyi bir sınıf için güzel bir şiir yazdık ve ığdır ilinde çay içtik dün",
}


def test_shouted_passages_of_other_scripts_are_verbatim():
    passages = d.Passages(list(enumerate(SPOKEN.values())), d.Budget())
    shouts = [t.upper() for t in SPOKEN.values()]
    shouts[-1] = SPOKEN["tr"].replace("i", "İ").upper()
    for write in (str, str.lower, str.title, lambda t: t.replace(" ", " \n ")):
        texts = [f"Ünï {write(t)} Ж ÇA" for t in shouts]
        found = d.search(passages, [t.encode() for t in texts])
        assert [(r[0], r[1], r[4]) for r in found] == [(i, i, 0) for i in range(len(texts))]
        assert all(texts[r[0]][r[2] : r[3]] == write(shouts[r[0]]) for r in found)


def test_only_real_edits_count_in_shouted_passages():
    for lang, text in SPOKEN.items():
        passages = d.Passages([(7, text)], d.Budget())
        most = int(passages.edits[0])
        for n in (most, most + 1):
            spots = range(5, 5 + 6 * n, 6)
            spoiled = "".join(c + "x" if i in spots else c for i, c in enumerate(text)).upper()
            found = d.search(passages, [f"ÀÉ {spoiled} öÜ".encode()])
            assert [r[4] for r in found] == ([n] if n <= most else []), (lang, n)


def test_fold_joins_all_forms_of_every_letter():
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        one = d.fold(char)
        assert one == char or code < d._CASED
        assert len(one) <= 3
        if char not in "\u0130":  # its lower() has two characters, joined in texts
            assert "".join(map(d.fold, char.lower())) == "".join(map(d.fold, char.upper())) == one, hex(code)
    plain = d._plain("a İi̇ \t É\ud800 😀ẞ".encode("utf-8", "surrogatepass"))
    assert plain[0].tobytes() == "a ii é\ud800 😀ss".encode("utf-8", "surrogatepass")
    assert plain[1].tolist() == [0, 1, 2, 3, 5, 8, 8, 9, 9, 9, 10, 11, 11, 11, 11, 12, 12]


def test_short_passages_are_found_verbatim():
    passages = d.Passages([(1, "What is the capital of Peru?"), (2, "Who is he?"), (3, "yes")], d.Budget())
    texts = ["so: what is the  capital of PERU? Lima", "who is he?", "yes", "who is hen?", "what is a capital of peru"]
    assert [(r[0], r[1], r[4]) for r in d.search(passages, [t.encode() for t in texts])] == [(0, 1, 0), (1, 2, 0)]


def test_a_shared_opening_phrase(monkeypatch):
    opening = "which of the following is correct about the "
    items = [(i, opening + prose(5, i)) for i in range(200)]
    passages = d.Passages(items, d.Budget())
    texts = [opening * 500, f"{prose(30, 1)} {items[7][1]} {opening * 20} {items[9][1]}x", "", opening + prose(5, 7000)]
    raw = [t.encode() for t in texts]
    started = time.perf_counter()
    got = d.search(passages, raw)
    assert time.perf_counter() - started < 20
    want = {(1, i) for i, p in items if distance(p, texts[1]) <= d.Budget().edits(len(p))}
    want |= {(3, i) for i, p in items if distance(p, texts[3]) <= d.Budget().edits(len(p))}
    assert {(r[0], r[1]) for r in got} == want and {(1, 7), (1, 9)} <= want
    monkeypatch.setattr(d, "_SHARED", 1000)
    monkeypatch.setattr(d, "_PLACES", 5000)
    assert d.search(passages, raw[1:]) == [(r[0] - 1, *r[1:]) for r in got]


def test_bands_aligned_together_equal_single_ones():
    rng = random.Random(4)
    items = [(i, prose(6 + i, i)) for i in range(12)]
    passages = d.Passages(items, d.Budget())
    texts = [f"{prose(3, k)} {edited(items[k % 12][1], k % 5, rng)} {prose(3, -k)}" for k in range(60)]
    data, _ = d._plain(b"\0" + b"\0".join(t.encode() for t in texts) + b"\0")
    borders = np.flatnonzero(data == 0)
    bands, kinds = passages.bands(data), set()
    for item, low in bands:
        text = int(np.searchsorted(borders, max(low, 0) + len(passages.data[item]) // 2)) - 1
        left, right = int(borders[text]) + 1, int(borders[text + 1])
        edits = int(passages.edits[item])
        cost, _ = d.aligned(passages.data[item], data[left:right], low - left, 2 * (edits + 1) + 2, edits)
        one = d.within(passages, data, *(np.array([x]) for x in (item, low, left, right)))
        assert one[0] == (cost <= edits)
        kinds.add(bool(one[0]))
    assert kinds == {True, False}
