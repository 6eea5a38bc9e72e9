"""Ordered listings by page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipmill.operators.aggregates import page_info
from clipmill.schemas import DEFAULT_PAGE_SIZE, wire_name



def _orders(order_by: Sequence[str], id_column: str) -> list[tuple[str, bool]]:
    """(column, descending) of each key; the id comes last and breaks ties."""
    keys = [(c.removeprefix("-"), c.startswith("-")) for c in order_by]
    return keys if any(c == id_column for c, _ in keys) else [*keys, (id_column, False)]


def _sorting(order_by: Sequence[str], id_column: str) -> list[Column]:
    return [F.desc(c) if down else F.asc(c) for c, down in _orders(order_by, id_column)]


def _check(page_size: int, page: int = 1) -> None:
    if page < 1 or page_size < 1:
        raise ValueError(f"page and page size start at 1, got {page} and {page_size}")


def page(
    df: DataFrame,
    page: int = 1,
    page_size: int = DEFAULT_PAGE_SIZE,
    order_by: Sequence[str] = (),
    id_column: str = "id",
) -> DataFrame:
    """One 1-based page; the id breaks ties, a page past the end is empty.

    A column named with a leading ``-`` is ordered downwards. Nulls come first upwards, last
    downwards. Spark keeps the best ``page * page_size`` rows of each partition, so this is for pages
    near the front: to walk a listing use :func:`page_after`, to jump about in it :func:`number_rows`
    and :func:`numbered_page`.
    """
    _check(page_size, page)
    return df.orderBy(*_sorting(order_by, id_column)).offset((page - 1) * page_size).limit(page_size)


def numbered_page(numbered: DataFrame, page: int = 1, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """One page of a listing that :func:`number_rows` has written, without sorting it again."""
    _check(page_size, page)
    last = page * page_size
    here = (F.col("row_number") > last - page_size) & (F.col("row_number") <= last)
    return numbered.where(here).orderBy("row_number").drop("row_number")


def page_envelope(
    df: DataFrame,
    item_key: str,
    page: int = 1,
    page_size: int = DEFAULT_PAGE_SIZE,
    order_by: Sequence[str] = (),
    id_column: str = "id",
) -> DataFrame:
    """One row ``json``: the page as listings print it, ``{<item_key>: [...], page, pageSize, ...}``."""
    _check(page_size, page)
    sorting = _sorting(order_by, id_column)
    item = F.struct(*[F.col(c).alias(wire_name(c)) for c in df.columns])
    start = (page - 1) * page_size
    rows = df.orderBy(*sorting).offset(start).limit(page_size)
    # The place on the page leads the pair, so sorting the pairs restores the page's order.
    rows = rows.withColumn("_place", F.row_number().over(Window.orderBy(*sorting)))
    pairs = F.sort_array(F.collect_list(F.struct("_place", item.alias("item"))))
    items = rows.agg(F.transform(pairs, lambda pair: pair["item"]).alias(item_key))
    info = page_info(df, page, page_size).drop("next_page")
    counts = info.select(F.struct(*[F.col(c).alias(wire_name(c)) for c in info.columns])).scalar()
    fields = [counts.getField(wire_name(c)).alias(wire_name(c)) for c in info.columns]
    return items.select(F.to_json(F.struct(item_key, *fields), {"ignoreNullFields": "false"}).alias("json"))


def number_rows(
    df: DataFrame, path: str, order_by: Sequence[str] = (), id_column: str = "id"
) -> DataFrame:
    """Write the listing sorted to ``path`` and read it back with its ``row_number``.

    The sort is spread over ranges. A row's number is its place within its range plus the sizes of
    the ranges before, so no task sees more than one range.
    """
    df.orderBy(*_sorting(order_by, id_column)).withColumn("_place", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
    # The upper bits of a place are the range, the lower 33 the row within it.
    placed = df.sparkSession.read.parquet(path).withColumn("_range", F.shiftright("_place", 33))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # One row per range: small enough for one task and for a broadcast.
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(F.broadcast(before), "_range")
        .withColumn("row_number", F.col("_before") + within + 1)
        .select(*df.columns, "row_number")
    )


def page_after(
    df: DataFrame,
    last: dict[str, object] | None,
    page_size: int = DEFAULT_PAGE_SIZE,
    order_by: Sequence[str] = (),
    id_column: str = "id",
) -> DataFrame:
    """The page after the row with the key values ``last`` (``None``: the first page).

    Order and nulls are those of :func:`page`. The bound on the leading key reaches the scan as a
    filter, unless nulls on its far side may follow.
    """
    _check(page_size)
    if last is not None:
        after, same = F.lit(False), F.lit(True)
        for k, (name, down) in enumerate(_orders(order_by, id_column)):
            key, bound = F.col(name), F.lit(last[name]).cast(df.schema[name].dataType)
            if last[name] is None:  # nulls come first upwards, last downwards
                beyond, reached = (F.lit(False), key.isNull()) if down else (key.isNotNull(), F.lit(True))
            elif down:
                beyond, reached = (key < bound) | key.isNull(), (key <= bound) | key.isNull()
            else:
                beyond, reached = key > bound, key >= bound
            if k == 0:
                df = df.where(reached)
            after, same = after | (same & beyond), same & key.eqNullSafe(bound)
        df = df.where(F.coalesce(after, F.lit(False)))
    return df.orderBy(*_sorting(order_by, id_column)).limit(page_size)
