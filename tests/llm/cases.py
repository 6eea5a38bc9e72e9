"""Rows every operator must survive, and word-level helpers for brute force."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed=0):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(n))


def awkward():
    """Nulls in every column, empty and very long texts, repeated rows."""
    long = prose(30_000, 1)
    return [
        (None, prose(50, 2), None, None, None),
        (1, None, "en", "a", 0),
        (2, "", "en", "a", 0),
        (3, " \n\t ", None, "a", 4),
        (4, long, "en", "b", len(long)),
        (5, prose(60, 3), "en", "b", None),
        (5, prose(60, 3), "en", "b", None),
        (6, "é ü 漢字 😀", "de", None, 8),
    ]
