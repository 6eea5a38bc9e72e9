import hashlib
import math
import random

import numpy as np
import pytest

from clipmill.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, books=vc.Books()):
    """vec_id -> (code, error, label_error), and the digest, in plain integers without pivots."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    vectors = [[math.floor(books.scale * float(np.float32(x))) for x in v] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, vectors[i]))[: books.entries]
    width = len(vectors[0]) // books.parts
    part = lambda v, j: v[j * width : (j + 1) * width]
    entries = [[part(vectors[i], j) for i in order] for j in range(books.parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min((gap(part(v, j), e), k) for k, e in enumerate(entries[j])) for j in range(books.parts)] for v in vectors]
    for _ in range(books.rounds):
        codes = assign()
        for j in range(books.parts):
            for k in range(len(entries[j])):
                own = [part(v, j) for v, c in zip(vectors, codes) if c[j][1] == k]
                if own:
                    entries[j][k] = [sum(x) // len(own) for x in zip(*own)]
    codes, totals = assign(), {}
    errors = [sum(d for d, _ in c) for c in codes]
    for (_, _, label), e in zip(kept, errors):
        totals[label] = totals.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in entries for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in c), e, totals[label]) for (i, _, label), c, e in zip(kept, codes, errors)), key=str), digest


def check(spark, rows, books=vc.Books(), parts=4):
    got = vc.encode(spark.createDataFrame(rows, SCHEMA).repartition(parts), books).collect()
    want, digest = brute(rows, books)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == want
    assert {r.codebooks_sha256 for r in got} == {digest}


def clustered(n, seed, dim=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = centres[rng.integers(0, 12, n)] + 0.2 * rng.normal(size=(n, dim))
    return [(int(i), [float(np.float32(x)) for x in v], int(i) % 5) for i, v in zip(rng.permutation(n) + 7, rows)]


def test_codes_equal_brute_force(spark):
    check(spark, clustered(300, 1))


def test_ties_repeated_rows_and_few_values(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice((-1.0, 0.0, 1.0)) for _ in range(16)], None if i % 3 else 1) for i in range(200)]
    rows += [rows[5]] * 40 + [(None, rows[9][1], None)] * 2
    check(spark, rows)


def test_fewer_vectors_than_entries(spark):
    check(spark, clustered(9, 4))
    check(spark, [(1, [0.5] * 8, None)])
    check(spark, clustered(60, 5, 12), vc.Books(parts=3, entries=5, rounds=2, pivots=1))


def test_awkward_rows(spark):
    good = clustered(40, 6, 16)
    bad = [(100, None, 1), (101, [], 1), (102, [None] * 16, 1), (103, [float("nan")] * 16, 2), (104, [0.0] * 15 + [float("inf")], 2)]
    odd = [(105, [1.0] * 8, 3)]
    rows = spark.createDataFrame([(*r, "x", 1.5) for r in good + bad + odd], SCHEMA + ", code string, v double")
    got = vc.encode(rows).collect()
    want, digest = brute(good)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == want and got[0].codebooks_sha256 == digest
    assert vc.encode(rows.where("false")).count() == 0 == vc.encode(rows.where("vec_id in (100, 103)")).count()
    with pytest.raises(ValueError):
        vc.encode(spark.createDataFrame([(1, [1.0] * 9, 1)], SCHEMA))
    with pytest.raises(Exception, match="131072 or more"):
        vc.encode(spark.createDataFrame([(1, [100.0] * 8, 1)], SCHEMA))


def test_pivots_spare_most_distances():
    values = np.array([[math.floor(4096 * x) for x in v[:8]] for _, v, _ in clustered(3000, 7)], dtype=np.int64)
    entries = values[:16]
    pivots = vc.choose_pivots(entries, 3)
    stored = vc._distances(values, pivots).astype(np.float32)
    code, distance, evaluated = vc.nearest(values, stored, entries, pivots)
    full = ((values[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (code == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert evaluated < 0.6 * full.size


def test_pivots_are_distinct_entries():
    entries = np.array([[0, 0], [5, 0], [0, 0], [9, 9]])
    assert vc.choose_pivots(entries, 4).tolist() == [[0, 0], [9, 9], [5, 0]]
    assert vc.choose_pivots(entries[:1], 3).tolist() == [[0, 0]]
