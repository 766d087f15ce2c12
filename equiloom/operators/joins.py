"""Join shapes Spark has no direct operator for."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from equiloom.functions.frames import top_per_group


def of_symbols(facts: DataFrame, listed: DataFrame, key: str = "symbol") -> DataFrame:
    """Fact rows of the listed symbols, with the listing's columns.

    Both sides meet on the hash partitioning of the symbol that every per-symbol operator
    uses anyway, so the facts move once at most and keep their order. The build side is one
    narrow row per symbol and cannot be skewed; the facts are never the broadcast side,
    whatever a small test table makes the planner estimate.
    """
    return facts.join(listed.hint("shuffle_hash"), key)


def star_join(base: DataFrame, tables: Sequence[DataFrame], key: str = "symbol") -> DataFrame:
    """Left joins of one-row-per-key tables; how each meets the base is left to its size and partitioning."""
    for table in tables:
        base = base.join(table, key, "left")
    return base


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str,
               values: Sequence[str], bucket: Callable[[Column], Column] | None = None, order: Sequence[str] = ()) -> DataFrame:
    """For each left row, the right values at the latest time not after its own.

    Only the distinct (key, time) pairs of the left side enter the window; the values then come back by an equi-join,
    which adaptive execution can split when a pair is hot. That bounds a window by the calendar where the right side has one row
    per key and day. Where it has events, give ``bucket``, a function of time that never falls (a day, an hour): the right side shrinks
    to one row per key and moment (the largest ``order``, then values), windows hold one bucket of a key, and what was last
    known before a bucket comes from a table of one row per key and bucket.
    """
    wanted = left.select(key, F.col(left_time).alias("_t")).distinct()
    facts = F.struct(*values)
    if bucket is None:
        marks = _marks(wanted, right.select(key, F.col(right_time).alias("_t"), facts.alias("_v")), key)
        seen = Window.partitionBy(key).orderBy("_t", "_asks").rowsBetween(Window.unboundedPreceding, 0)
        filled = marks.withColumn("_v", F.last("_v", ignorenulls=True).over(seen)).where("_asks = 1")
    else:
        filled = _filled_by_bucket(wanted, right, key, right_time, facts, bucket, order)
    answers = filled.select(F.col(key).alias("_k"), "_t", "_v.*")
    matched = (left[key] == answers["_k"]) & (left[left_time] == answers["_t"])
    return left.join(answers, matched, "left").select(left["*"], *values)


def as_of_series(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: Sequence[str]) -> DataFrame:
    """As ``as_of_join``, for a left side whose rows of a key the calendar bounds, as those of a price series.

    Its rows pass through the window themselves: both sides move once, on the key, and nothing is joined back.
    """
    asked = left.withColumns({"_t": F.col(left_time), "_asks": F.lit(1)})
    known = right.select(key, F.col(right_time).alias("_t"), F.lit(0).alias("_asks"), F.struct(*values).alias("_v"))
    seen = Window.partitionBy(key).orderBy("_t", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    filled = asked.unionByName(known, allowMissingColumns=True).withColumn("_v", F.last("_v", ignorenulls=True).over(seen)).where("_asks = 1")
    placed = F.col(key).isNotNull() & F.col("_t").isNotNull()
    return filled.select(*left.columns, *(F.when(placed, F.col("_v")[v]).alias(v) for v in values))


def _marks(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Moments asked for and moments known, in one table; on the same moment what is known comes first."""
    none = F.lit(None).cast(known.schema["_v"].dataType)
    return wanted.select(key, "_t", F.lit(1).alias("_asks"), none.alias("_v")).unionByName(known.select(key, "_t", F.lit(0).alias("_asks"), "_v"))


def _filled_by_bucket(wanted: DataFrame, right: DataFrame, key: str, time: str, facts: Column, bucket: Callable[[Column], Column], order: Sequence[str]) -> DataFrame:
    known = right.where(F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(key, F.col(time).alias("_t")).agg(F.max_by(facts, F.struct(*order, facts)).alias("_v"))
    marks = bucketed(_marks(wanted, known, key), bucket)
    inside = Window.partitionBy(key, "_bucket").orderBy("_t", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    filled = marks.withColumn("_v", F.last("_v", ignorenulls=True).over(inside))
    # Same keys as the window's: no further shuffle.
    ends = filled.groupBy(key, "_bucket").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct("_t", F.lit(1) - F.col("_asks")))).alias("_last"))
    over = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(key, "_bucket", F.last("_last", ignorenulls=True).over(over).alias("_before"))
    asked = filled.where("_asks = 1").join(carried, [key, "_bucket"], "left")
    return asked.select(key, "_t", F.coalesce("_v", "_before").alias("_v"))


def bucketed(marks: DataFrame, bucket: Callable[[Column], Column]) -> DataFrame:
    return marks.withColumn("_bucket", bucket(F.col("_t")))


def latest_not_after(right: DataFrame, key: str, time: str, value: str, moment: Column, name: str) -> DataFrame:
    """One value per key at the latest time not after a single moment: a plain aggregate."""
    return right.where(F.col(time) <= moment).groupBy(key).agg(F.max_by(value, time).alias(name))


def nth_later(column: str, time: str, n: int, days: int, window) -> Column:
    """The n-th later row's value, when that row lies within ``days``."""
    reached = F.lead(time, n).over(window) <= F.date_add(F.col(time), days)
    return F.when(reached, F.lead(column, n).over(window))


def day_periods(days: DataFrame, periods: DataFrame, open_start: bool = False) -> DataFrame:
    """Which periods each trading day lies in: [start, end), or (start, end] when open.

    Periods become their days and meet the calendar on the day; both are bounded by the calendar.
    """
    first, last = (F.date_add("period_start", 1), F.col("period_end")) if open_start else (F.col("period_start"), F.date_sub("period_end", 1))
    inside = periods.where(first <= last).withColumn("trade_date", F.explode(F.sequence(first, last)))
    return days.select("trade_date").distinct().join(inside, "trade_date")


def in_period(facts: DataFrame, periods: DataFrame, days: DataFrame, open_start: bool = False) -> DataFrame:
    """Interval join as an equi-join: the day-to-period map is broadcast and met on the day."""
    return facts.join(F.broadcast(day_periods(days, periods, open_start)), "trade_date")


def interval_join(facts: DataFrame, periods: DataFrame, time: str, start: str, end: str, seconds: int, keys: Sequence[str] = ()) -> DataFrame:
    """Each fact with the periods [start, end) its moment lies in, all of them where they overlap; ``keys`` must be equal, too.

    Time is cut into ranges of ``seconds``. A fact has one, a period those it touches, and both meet on the range and the keys; only
    then are the ends compared. Choose ranges of about a period's length: shorter ones copy periods, longer ones compare in vain. Facts and periods
    without a moment, and empty periods, meet nothing.
    """
    def place(moment: Column) -> Column:
        return F.floor(F.unix_micros(moment.cast("timestamp")) / (seconds * 1_000_000))

    last = F.timestamp_micros(F.unix_micros(F.col(end).cast("timestamp")) - 1)
    touched = periods.where(F.col(start) < F.col(end)).withColumn("_range", F.explode(F.sequence(place(F.col(start)), place(last))))
    met = facts.withColumn("_range", place(F.col(time))).join(touched, [*keys, "_range"])
    return met.where((F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))).drop("_range")


TYPES = ("VALUE", "GROWTH", "DIVIDEND")


def signals_for_accounts(accounts: DataFrame, signals: DataFrame, n: int) -> DataFrame:
    """Each account meets the best ``n`` signals of its strategy; BALANCED meets all types.

    An account can use only signals that are among the best ``n`` of their type, so the
    signal side shrinks to ``n`` rows per type first, and to the best ``n`` of each strategy: small enough to broadcast at any scale,
    where a shuffle on the three-valued type would gather a third of the accounts in a task.
    Accounts are told apart before they meet signals, so that no sort holds the pairs; only rows that share an id compete for ``n`` places.
    """
    order = [F.desc("score"), F.asc("symbol")]
    kind, all_types = F.col("portfolio_type"), "BALANCED"
    few = top_per_group(signals, ["portfolio_type"], order, n, "_place").drop("_place")
    users = F.when(kind.isin(*TYPES), F.array(kind, F.lit(all_types))).when(kind != all_types, F.array(kind))
    best = F.broadcast(top_per_group(few.withColumn("_strategy", F.explode(users)), ["_strategy"], [*order, F.asc("portfolio_type")], n))
    counted = accounts.drop("portfolio_type").withColumn("_rows", F.count("*").over(Window.partitionBy("account_id")))
    columns = ["portfolio_type", *(c for c in accounts.columns if c != "portfolio_type"), *(c for c in signals.columns if c != "portfolio_type"), "row_no"]
    met = counted.join(best, F.col("strategy") == F.col("_strategy"))
    shared = top_per_group(met.where("_rows > 1"), ["account_id"], [*order, F.asc("portfolio_type")], n)
    return met.where("_rows = 1").select(*columns).unionByName(shared.select(*columns))
