"""Window specs and per-key picks.

A window here is always partitioned by a key whose rows are bounded by the calendar: one
row per (symbol, trading day), (symbol, quarter) or (sector, day). Ordering needs over
unbounded groups go through ``ranking`` or a grouped aggregate instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from equiloom.functions.expressions import ratio

TEN, FIFTY = 10, 50


def by_symbol(order: str = "trade_date", key: str | Sequence[str] = "symbol") -> WindowSpec:
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys).orderBy(order)


def trailing(rows: int, order: str = "trade_date", key="symbol") -> WindowSpec:
    """The current row and the ``rows - 1`` before it."""
    return by_symbol(order, key).rowsBetween(1 - rows, 0)


def running(order: str = "trade_date", key="symbol") -> WindowSpec:
    return by_symbol(order, key).rowsBetween(Window.unboundedPreceding, 0)


def trailing_means(df: DataFrame, means: dict[str, tuple[str, int]], order: str = "trade_date", key: str = "symbol") -> DataFrame:
    """Means of the newest rows: ``{name: (column, rows)}``.

    Each frame adds up its own rows, so a NaN or a spike leaves with the row that brought it. All frames share one sort. Spark adds up
    every row of a frame anew for each row, so wide frames are put together: sums of ten rows give sums of fifty, and these the rest.
    """
    wide = {name: m for name, m in means.items() if m[1] > 2 * TEN and m[1] % TEN == 0}
    long = {c for c, rows in wide.values() if rows >= 2 * FIFTY}
    at = by_symbol(order, key)

    def pieces(c: str, rows: int) -> list[tuple[str, int]]:
        """Sums that make up the newest rows, with how far back each ends."""
        fifties = rows // FIFTY if c in long and rows >= 2 * FIFTY else 0
        return [(f"_{FIFTY}_{c}", FIFTY * n) for n in range(fifties)] + [(f"_{TEN}_{c}", n) for n in range(FIFTY * fifties, rows, TEN)]

    def total(of: str, parts: list[tuple[str, int]]) -> Column:
        back = (F.col(f"{of}{piece}") if n == 0 else F.lag(f"{of}{piece}", n).over(at) for piece, n in parts)
        return reduce(add, (F.coalesce(x, F.lit(0)) for x in back))

    value = {c: F.col(c).cast("double") for c, _ in wide.values()}
    tens = {f"{of}_{TEN}_{c}": f(x).over(trailing(TEN, order, key)) for c, x in value.items() for of, f in (("_sum", F.sum), ("_count", F.count))}
    fifties = {f"{of}_{FIFTY}_{c}": total(of, [(f"_{TEN}_{c}", n) for n in range(0, FIFTY, TEN)]) for c in sorted(long) for of in ("_sum", "_count")}
    narrow = {name: F.avg(F.col(c).cast("double")).over(trailing(rows, order, key)) for name, (c, rows) in means.items() if name not in wide}
    joined = {name: ratio(total("_sum", pieces(c, rows)), total("_count", pieces(c, rows))) for name, (c, rows) in wide.items()}
    found = df.withColumns(tens | narrow).withColumns(fifties).withColumns(joined)
    return found.select(*df.columns, *(name for name in means if name not in df.columns))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                  name: str = "row_no") -> DataFrame:
    """First ``n`` rows per key. Spark trims each input partition to ``n`` rows per key
    before the shuffle (window group limit), so a hot key ships ``n`` rows per task."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, number).where(F.col(name) <= n)


def latest_by(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Newest row per key, as a partial aggregate rather than a sort."""
    others = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*others), F.col(order)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*").select(*df.columns)


def newest_value(df: DataFrame, column: str) -> Column:
    """Largest value of a column as a scalar subquery: no join, usable in any filter."""
    return df.agg(F.max(column)).scalar()


def within(df: DataFrame, column: str, days: int, as_of: Column) -> DataFrame:
    """Rows at most ``days`` calendar days before ``as_of``."""
    return df.where((F.col(column) >= F.date_sub(as_of, days)) & (F.col(column) <= as_of))


def quarters_only(statements: DataFrame) -> DataFrame:
    """Quarterly rows of a statement table, which holds annual ones of the same dates too; a table without period types is quarterly."""
    return statements.where(F.col("period_type") == "quarterly") if "period_type" in statements.columns else statements
