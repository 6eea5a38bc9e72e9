"""Quality rules as a ledger: every rule is evaluated once per document, its outcome stored as a bit.

`ledger` takes the measurements of a document and sets one bit for each rule it fails. A policy is
then only a mask of the rules that count, so policies can be versioned, compared and ablated on the
stored ledger with bitwise operations, without reading a text again.

Everything is built-in functions over one row: the ledger needs no shuffle.

Defined results: a null or empty text has no words, all measurements 0, and fails `few_words`. Ids
may be null or repeated; each row gets its own ledger row. Columns of the input that clash with the
ledger's own are replaced by them. An empty table gives an empty ledger and zero counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmill.functions.once import once
from clipmill.llm.common import SPACE, others, quoted, text_of, words_of

#: Words in a window for repeated passages.
WINDOW = 8

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_run_words",
    "n_upper", "n_lower",
)


@dataclass(frozen=True)
class Rule:
    """A named test on measurements; its place in `RULES` is its bit."""

    name: str
    fails: Callable[[dict[str, Column]], Column]


#: The order is part of the stored format: add rules at the end only.
RULES = (
    Rule("few_words", lambda m: m["n_words"] < 20),
    Rule("repeated_passages", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
    Rule("symbols", lambda m: 100 * m["n_symbols"] > 30 * m["n_words"]),
    Rule("repeated_lines", lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"]),
    Rule("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"])),
    Rule("word_runs", lambda m: 100 * m["n_run_words"] > 30 * m["n_words"]),
    Rule("capitals", lambda m: (m["n_upper"] > m["n_lower"]) & (m["n_upper"] >= 20)),
)
BITS = {rule.name: 1 << i for i, rule in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """The rules that count, under a version that results can name."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[name] for name in set(self.rules))


BASE = Policy("base-1", ("few_words", "repeated_passages"))
STRICT = Policy("strict-1", tuple(BITS))


def _symbols(text: Column, kinds: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, kinds, ""))).cast("long")


def _covered(windows: Column) -> Column:
    """Words inside windows that occur twice or more, given each window's hash by position."""

    def starts(pairs: Column) -> Column:
        same = lambda s, k: (F.get(pairs, k - 1)["h"] == s["h"]) | (F.get(pairs, k + 1)["h"] == s["h"])
        marked = F.transform(pairs, lambda s, k: F.when(same(s, k), s["i"]))
        return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

    def length(at: Column) -> Column:
        steps = F.transform(at, lambda i, k: F.least(F.coalesce(F.get(at, k + 1) - i, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return once(once(pairs, starts), length)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements of `MEASURES` (all long) beside its other columns."""
    kept = [F.col(quoted(c)) for c in others(docs, *MEASURES)]
    row = F.struct(*kept).alias("row")
    split = docs.select(row, text_of(text).alias("t")).select(
        "row", "t", words_of(F.col("t")).alias("w"), F.split("t", "\n").alias("l")
    )
    hashed = split.select(
        "row",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"),
        _symbols(F.col("t"), r"[#*$%&|<>]").alias("n_symbols"),
        _symbols(F.col("t"), "[A-Z]").alias("n_upper"),
        _symbols(F.col("t"), "[a-z]").alias("n_lower"),
        F.filter("l", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"),
        F.transform("w", lambda w: F.xxhash64(w)).alias("w"),
    )
    n = F.size("w")
    window = lambda i: F.xxhash64(*[F.get(F.col("w"), i + k) for k in range(WINDOW)])
    windowed = hashed.select(
        "*",
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window))
        .otherwise(F.array().cast("array<bigint>"))
        .alias("h"),
    )
    counted = windowed.select(
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("h")) < F.size("h"), _covered(F.col("h")))
        .otherwise(F.lit(0).cast("long"))
        .alias("n_repeat_words"),
        F.size(F.filter("w", lambda x, i: x == F.get(F.col("w"), i - 1))).cast("long").alias("n_run_words"),
        "n_upper",
        "n_lower",
    )
    return counted.select("row.*", *MEASURES)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Measurements and ``failed_bits`` (long): bit i is set if rule i of `RULES` fails."""
    docs = docs.select(*[F.col(quoted(c)) for c in others(docs, *MEASURES, "failed_bits")])
    measured = measure(docs, text)
    values = {name: F.col(name) for name in MEASURES}
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(rule.fails(values), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failed_bits", bits)


def passes(policy: Policy, bits: str = "failed_bits") -> Column:
    """Whether a ledger row passes a policy."""
    return F.col(quoted(bits)).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policy(ledger_rows: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with ``kept`` and the ``policy`` that decided it."""
    columns = [F.col(quoted(c)) for c in others(ledger_rows, "kept", "policy")]
    return ledger_rows.select(*columns, passes(policy).alias("kept"), F.lit(policy.version).alias("policy"))


def ablations(ledger_rows: DataFrame, policy: Policy) -> DataFrame:
    """What each rule of a policy does, from the stored bits alone.

    Per rule: ``n_failed`` rows fail it, ``n_alone`` fail no other rule of the policy, and
    ``kept_without`` rows would be kept if the rule were dropped. One aggregate over one scan.
    """
    bits = F.col("failed_bits")
    sums, rows = [F.count_if(passes(policy)).alias("kept")], []
    for name in policy.rules:
        bit = F.lit(BITS[name]).cast("long")
        sums.append(F.count_if(bits.bitwiseAND(bit) != 0).alias(f"failed_{name}"))
        sums.append(F.count_if(bits.bitwiseAND(F.lit(policy.mask).cast("long")) == bit).alias(f"alone_{name}"))
        rows.append(
            F.struct(
                F.lit(name).alias("rule"),
                F.col(f"failed_{name}").alias("n_failed"),
                F.col(f"alone_{name}").alias("n_alone"),
                (F.col("kept") + F.col(f"alone_{name}")).alias("kept_without"),
            )
        )
    return ledger_rows.agg(*sums).select(F.inline(F.array(*rows)))
