from collections import Counter

import pytest
from cases import SCHEMA, WORD, awkward, prose
from pyspark.sql import functions as F

from clipmill.llm import quality_rules as q


def brute(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = {w for w, c in Counter(windows).items() if c > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(8)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_run_words": sum(a == b for a, b in zip(words, words[1:])),
    }


def test_measures_equal_brute_force(spark):
    twice = prose(12, 7)
    rows = awkward() + [
        (10, f"{twice}\n{twice} x {twice}\n\n{twice}", "en", "a", 1),
        (11, "go " * 40, "en", "a", 1),
        (12, "a\nb\na\n \na", "en", "a", 1),
        (13, "#x *y $z %w &v |u <t >s", "en", "a", 1),
    ]
    got = q.ledger(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    key = lambda d: sorted(map(repr, d))
    want = [(r[0], *brute(r[1]).values()) for r in rows]
    assert key((r.doc_id, *(r[m] for m in brute(""))) for r in got) == key(want)


def test_bits_policies_and_ablations(spark):
    rows = [(1, prose(100, 1)), (2, "go " * 40), (3, "a b"), (4, None), (5, "THE SHOUTED LINE " + prose(30, 4).upper())]
    ledger = q.ledger(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    bits = {r.doc_id: r.failed_bits for r in ledger.collect()}
    assert bits[1] == 0 and bits[3] & q.BITS["few_words"] and bits[4] & q.BITS["few_words"]
    assert bits[2] & q.BITS["repeated_passages"] and bits[2] & q.BITS["word_runs"] and bits[5] == q.BITS["capitals"]
    kept = {r.doc_id: (r.kept, r.policy) for r in q.apply_policy(ledger, q.BASE).collect()}
    assert kept == {1: (True, "base-1"), 2: (False, "base-1"), 3: (False, "base-1"), 4: (False, "base-1"), 5: (True, "base-1")}
    for row in q.ablations(ledger, q.STRICT).collect():
        bit, rest = q.BITS[row.rule], q.STRICT.mask & ~q.BITS[row.rule]
        assert row.n_failed == sum(b & bit != 0 for b in bits.values())
        assert row.kept_without == sum(b & rest == 0 for b in bits.values())


def test_clashing_columns_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "x", 5, 6)], "doc_id long, text string, N_Words string, failed_bits int")
    got = q.ledger(rows)
    assert got.first().n_words == 1 and len(got.columns) == len(set(c.lower() for c in got.columns))
    empty = q.ledger(rows.where(F.lit(False)))
    assert empty.count() == 0 and {r.n_failed for r in q.ablations(empty, q.STRICT).collect()} == {0}


def test_no_python_in_the_plan(spark):
    plan = q.ledger(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_unknown_rule_in_a_policy():
    with pytest.raises(KeyError):
        q.Policy("x", ("no_such_rule",)).mask  # noqa: B018
