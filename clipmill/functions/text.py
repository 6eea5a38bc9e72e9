"""Display text as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipmill.functions.once import once

ELLIPSIS = "…"

# Marks a second terminal column while widths are counted; a Unicode noncharacter.
_FILLER = "\uffff"

# Printable ASCII and Latin letters, one column each.
_ONE_COLUMN = "^[\\x20-\\x7e\\xa1-\\xac\\xae-\\x{2ff}]*$"

# No column: marks, format and control characters, vowel and final Hangul jamo.
_NO_COLUMN = "\\p{Mn}\\p{Me}\\p{Cf}\\p{Cc}\\x{1160}-\\x{11ff}"

# Double-width code points lie between these.
_FIRST_WIDE, _LAST_WIDE = 0x1100, 0x3FFFD

# The code points with the Unicode property White_Space.
_WHITE_SPACE = (
    "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def truncate_chars(c: Column, n: int) -> Column:
    """At most ``n`` code points; longer text keeps ``n - 1`` and gets an ellipsis."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(max(n - 1, 0))), F.lit(ELLIPSIS))).otherwise(c)


@cache
def _wide_class() -> str:
    """Regex class of the double-width code points, from the Unicode database's East Asian widths."""
    ranges: list[list[int]] = []
    for point in range(_FIRST_WIDE, _LAST_WIDE + 1):
        if 0xD800 <= point <= 0xDFFF or unicodedata.east_asian_width(chr(point)) not in ("W", "F"):
            continue
        if ranges and point == ranges[-1][1] + 1:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    members = "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in ranges)
    # The outer range settles Latin text with one comparison.
    return f"[\\x{{{_FIRST_WIDE:x}}}-\\x{{{_LAST_WIDE:x}}}&&[{members}]]"


def truncate_width(c: Column, columns: int) -> Column:
    """Cut to a terminal width: CJK takes two columns, marks and control characters none.

    Text wider than ``columns`` keeps its longest prefix of at most ``columns - 1`` columns and
    gets an ellipsis.
    """
    return once(c, lambda text: _fit(text, columns))


def _fit(c: Column, columns: int) -> Column:
    zero, wide, budget = f"[{_NO_COLUMN}]", _wide_class(), max(columns - 1, 0)
    # Only one-column characters up to the cut: code points are columns.
    plain = F.rlike(F.left(c, F.lit(columns + 1)), F.lit(_ONE_COLUMN))
    # If the first stretch is wide enough it settles the matter; if not, the whole text is read.
    stretch = F.left(c, F.lit(4 * (columns + 1)))
    enough = F.length(F.regexp_replace(stretch, f"{zero}+", "")) > columns
    text = F.when(enough, stretch).otherwise(c)
    # A filler behind each double-width character makes one code point one column.
    spread = F.regexp_replace(text, f"({wide})", f"$1{_FILLER}")
    visible = F.regexp_replace(spread, f"{zero}+", "")
    kept = F.regexp_extract(spread, f"^{zero}*+(?:[^{_NO_COLUMN}]{zero}*+){{0,{budget}}}+", 0)
    # A double-width character whose filler did not fit is dropped.
    whole = F.regexp_replace(kept, f"{wide}$", "")
    cut = F.regexp_replace(whole, f"({wide}){_FILLER}", "$1")
    return (
        F.when(plain, truncate_chars(c, columns))
        .when(F.length(visible) > columns, F.concat(cut, F.lit(ELLIPSIS)))
        .otherwise(c)
    )


def one_decimal(c: Column) -> Column:
    """One decimal, rounding the exact value of the double half to even."""
    return F.call_function("format_number", c.cast("double"), F.lit("0.0"))


def human_bytes(c: Column) -> Column:
    """``512 B``, ``2.0 KB``, ``5.2 MB`` ... with TB as the largest unit."""
    size = c.cast("double")

    def scaled(power: int, unit: str) -> Column:
        return F.concat(one_decimal(size / F.lit(float(1024**power))), F.lit(f" {unit}"))

    return (
        F.when(size < 1024, F.concat(c.cast("string"), F.lit(" B")))
        .when(size < 1024**2, scaled(1, "KB"))
        .when(size < 1024**3, scaled(2, "MB"))
        .when(size < 1024**4, scaled(3, "GB"))
        .when(size.isNotNull(), scaled(4, "TB"))
    )


def seconds_text(c: Column) -> Column:
    return F.concat(one_decimal(c), F.lit("s"))


def time_range(start: Column, end: Column) -> Column:
    return F.concat(one_decimal(start), F.lit("–"), one_decimal(end), F.lit("s"))


def label_text(key: Column, value: Column, n: int = 18) -> Column:
    return truncate_chars(F.concat(key, F.lit("="), value.cast("string")), n)


def short_id(c: Column, n: int = 8) -> Column:
    return F.left(c, F.lit(n))


def elapsed_text(seconds: Column) -> Column:
    """``M:SS`` with unbounded minutes; fractions of a second are dropped."""
    whole = F.floor(seconds).cast("bigint")
    minutes = F.floor(whole / 60).cast("string")
    return F.concat(minutes, F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def clean_text(c: Column) -> Column:
    """Trim Unicode white space; blank becomes null."""
    return F.nullif(F.btrim(c, F.lit(_WHITE_SPACE)), F.lit(""))


def unless_blank(c: Column) -> Column:
    """The text as it is; one of white space only becomes null."""
    return F.when(clean_text(c).isNotNull(), c)


def or_dash(c: Column, dash: str = "-") -> Column:
    return F.coalesce(c.cast("string"), F.lit(dash))
