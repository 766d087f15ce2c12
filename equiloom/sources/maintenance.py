"""Keyed table upkeep: merges, updates, incremental loads and dividend derivation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from equiloom.functions.expressions import ladder


def pick_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """One whole row per key, the one with the largest ``order``.

    A partial aggregate: each task keeps one row per key before the shuffle, so repeats of
    a hot key never travel.
    """
    others = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*others), order).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*df.columns)


def merge_latest(old: DataFrame, new: DataFrame, keys: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """Upsert: a new row replaces the old one on its key; inside a batch the later row wins."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return pick_per_key(both, keys, F.struct("_new", *order_cols)).drop("_new")


def merge_stamped(old: DataFrame, new: DataFrame, keys: Sequence[str], order_cols: Sequence[str], stamp: str, now: Column) -> DataFrame:
    """An upsert that keeps the time of the last change: a row gets the stamp ``now`` if it is new or some value differs, else it keeps its own.

    ``new`` has no stamp column. Values are compared themselves, nulls equal. One aggregate on the key: each task brings at most
    one old and one new row of a key to the shuffle. An old row without a stamp counts as changed.
    """
    values = [c for c in new.columns if c not in keys]
    both = old.select(*keys, *values, F.col(stamp).alias("_stamp"), F.lit(False).alias("_new")).unionByName(
        new.select(*keys, *values, F.lit(None).cast(old.schema[stamp].dataType).alias("_stamp"), F.lit(True).alias("_new")))
    row = F.struct(*values)
    order = F.struct(*[F.col(c) for c in order_cols])
    merged = both.groupBy(*keys).agg(
        F.max_by(F.when(F.col("_new"), row), F.when(F.col("_new"), order)).alias("_after"),
        F.max_by(F.when(~F.col("_new"), F.struct(row.alias("row"), F.col("_stamp").alias("stamp"))), F.when(~F.col("_new"), order)).alias("_before"),
    )
    untouched = F.col("_after").isNull() | F.col("_after").eqNullSafe(F.col("_before.row"))
    stamped = F.when(untouched & F.col("_before.stamp").isNotNull(), F.col("_before.stamp")).otherwise(now)
    return merged.select(*keys, F.coalesce("_after", "_before.row").alias("_row"), stamped.alias(stamp)).select(*keys, "_row.*", stamp)


def dedupe_on_key(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """Natural-key uniqueness with a stated survivor (``dropDuplicates`` keeps an arbitrary one)."""
    return pick_per_key(df, keys, F.struct(*order_cols))


def update_from(target: DataFrame, source: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Source values replace the target's where the key matches and the value is present."""
    incoming = source.select(*keys, *[F.col(c).alias(f"_{c}") for c in cols])
    updated = target.join(incoming, list(keys), "left").withColumns(
        {c: F.coalesce(F.col(f"_{c}"), F.col(c)) if c in target.columns else F.col(f"_{c}") for c in cols}
    )
    extra = [c for c in cols if c not in target.columns]
    return updated.select(*target.columns, *extra)


def incremental_new_rows(source: DataFrame, target: DataFrame, key: str | None, ts: str) -> DataFrame:
    """Rows later than what the target holds: per key, or overall when ``key`` is None."""
    if key is None:
        seen = target.agg(F.max(ts)).scalar()
        return source.where(seen.isNull() | (F.col(ts) > seen))
    last = target.groupBy(key).agg(F.max(ts).alias("_last"))
    fresh = F.col("_last").isNull() | (F.col(ts) > F.col("_last"))
    return source.join(last, key, "left").where(fresh).drop("_last")


def dividends_from_prices(prices: DataFrame, universe: DataFrame, since: Column | None = None) -> DataFrame:
    """Dividend rows from priced days that paid; dates around the ex-date are estimates."""
    paid = prices.where(F.col("dividend_amount") > 0)
    if since is not None:
        paid = paid.where(since.isNull() | (F.col("trade_date") > since))
    split = F.coalesce(F.col("split_coefficient"), F.lit(1.0)) if "split_coefficient" in prices.columns else F.lit(1.0)
    currency = F.col("currency") if "currency" in universe.columns else F.lit(None).cast("string")
    amount, day = F.col("dividend_amount"), F.col("trade_date")
    listed = universe.select("symbol", currency.alias("currency"))
    return paid.join(listed, "symbol", "left").select(
        "symbol", day.alias("ex_date"), F.date_add(day, 14).alias("payment_date"),
        F.date_add(day, 2).alias("record_date"), F.date_sub(day, 21).alias("declaration_date"),
        amount.alias("dividend"), (amount * split).alias("adjusted_dividend"),
        F.coalesce("currency", F.lit("USD")).alias("currency"),
        ladder(amount, [(0.5, "QUARTERLY"), (1.0, "SEMI_ANNUAL")], "ANNUAL", by="<").alias("frequency"),
    )


def fill_dividend_dates(df: DataFrame) -> DataFrame:
    day = F.col("ex_date")
    return df.withColumns({
        "payment_date": F.coalesce("payment_date", F.date_add(day, 21)),
        "record_date": F.coalesce("record_date", F.date_add(day, 2)),
        "declaration_date": F.coalesce("declaration_date", F.date_sub(day, 28)),
        "adjusted_dividend": F.coalesce("adjusted_dividend", "dividend"),
    })
