"""Word-shingle sets of whole texts as 64-bit hashes, computed for many texts at once in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SEEDS = np.random.default_rng(20240501)
_BYTE = _SEEDS.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32  # A-Z to a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_BACK = pow(_STEP, -1, 2**64)
_NEXT = np.uint64(0xD1342543DE82EF95)
#: Bytes of text handled at a time; a longer text is handled alone and whole.
CHUNK = 1 << 18

_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(which: int, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        steps = np.full(2 * n, (_STEP, _BACK)[which], dtype=np.uint64)
        steps[0] = 1
        _powers[which] = np.cumprod(steps)
    return _powers[which][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word (A-Z in lower case) of every text, and each text's first word."""
    buffer = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    space = _SPACE[buffer]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    terms = _BYTE[_FOLD[buffer]]
    terms[space] = 0
    total = np.zeros(len(buffer) + 1, dtype=np.uint64)
    np.cumsum(terms * _power(0, len(buffer)), out=total[1:])
    hashes = mixed((total[ends] - total[starts]) * _power(1, len(buffer))[starts])
    first = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))
    return hashes, first


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Each text's distinct shingles of ``size`` words, sorted; of fewer words, all as one shingle."""
    words, first = word_hashes(texts)
    m = len(words) - size + 1
    rolled = np.zeros(max(m, 0), dtype=np.uint64)
    for k in range(size if m > 0 else 0):
        rolled = rolled * _NEXT + words[k : k + m]
    rolled = mixed(rolled)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            sets.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            one = np.uint64(b - a)
            for w in words[a:b]:
                one = np.uint64((int(one) * int(_NEXT) + int(w)) % 2**64)
            sets.append(mixed(np.array([one], dtype=np.uint64)))
        else:
            sets.append(np.empty(0, dtype=np.uint64))
    return sets


def chunks(texts: list[str | None]) -> Iterator[tuple[slice, list[bytes]]]:
    """Runs of texts of about `CHUNK` bytes together, as UTF-8."""
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(data) > CHUNK:
            yield slice(start, i), held
            start, held, size = i, [], 0
        held.append(data)
        size += len(data)
    if held:
        yield slice(start, len(texts)), held
