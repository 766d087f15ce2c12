"""Per-symbol time-series operators.

Windows are partitioned by symbol and ordered by day. A price table holds one row per
(symbol, trading day) — ``merge_latest`` enforces it — so a partition is bounded by the
calendar and no symbol can be hot. Windows over the same spec share one shuffle and sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from equiloom.functions.expressions import as_int, change, ratio
from equiloom.functions.frames import by_symbol, quarters_only, running, top_per_group, trailing, trailing_means

YEAR_ROWS = 252


def moving_averages(bars: DataFrame, spans: tuple[int, ...] = (20, 50, 200)) -> DataFrame:
    return trailing_means(bars, {f"sma_{n}": ("close", n) for n in spans})


def volume_ratio(bars: DataFrame, spans: tuple[int, ...] = (20, 50)) -> DataFrame:
    averaged = trailing_means(bars, {f"avg_volume_{n}": ("volume", n) for n in spans})
    return averaged.withColumn("volume_ratio", ratio(F.col("volume"), F.col(f"avg_volume_{spans[0]}")))


def rolling_range(bars: DataFrame, rows: int = YEAR_ROWS) -> DataFrame:
    return bars.withColumns({
        "high_52w": F.max("high").over(trailing(rows)), "low_52w": F.min("low").over(trailing(rows))
    })


def daily_returns(bars: DataFrame) -> DataFrame:
    return bars.withColumn("daily_return", change(F.col("close"), F.lag("close").over(by_symbol())))


def benchmark_returns(bench: DataFrame) -> DataFrame:
    """Returns of one series. A series is one row per trading day, so its single window
    partition is bounded by the calendar; the constant key says it is one partition."""
    one = Window.partitionBy(F.lit(1)).orderBy("trade_date")
    return bench.withColumn("market_return", change(F.col("close"), F.lag("close").over(one)))


def rolling_volatility(bars: DataFrame, rows: int = 20) -> DataFrame:
    spread = bars.withColumn("volatility_20d", F.stddev_samp("close").over(trailing(rows)))
    return spread.withColumn("normalized_volatility", ratio(F.col("volatility_20d"), F.col("close")))


def forward_changes(bars: DataFrame, horizons: dict[str, int]) -> DataFrame:
    order = by_symbol()
    return bars.withColumns({name: change(F.lead("close", n).over(order), F.col("close")) for name, n in horizons.items()})


def year_ago(quarters: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    order = by_symbol("fiscal_date")
    return quarters_only(quarters).withColumns({f"prior_{c}": F.lag(c, 4).over(order) for c in columns})


def rsi(bars: DataFrame, period: int = 14) -> DataFrame:
    """Simple-mean RSI. The first, missing, difference counts as zero; a series without
    losses reads 100 and a flat one has no value."""
    step = F.coalesce(F.col("close") - F.lag("close").over(by_symbol()), F.lit(0.0))
    moved = bars.withColumn("_step", step).withColumn("_row", F.row_number().over(by_symbol()))
    frame = trailing(period)
    moved = moved.withColumns({
        "_gain": F.avg(F.greatest("_step", F.lit(0.0))).over(frame),
        "_loss": F.avg(F.greatest(-F.col("_step"), F.lit(0.0))).over(frame),
    })
    # 100 - 100/(1 + gain/loss) in the form that also covers a loss of zero.
    value = ratio(100 * F.col("_gain"), F.col("_gain") + F.col("_loss"))
    return moved.withColumn("rsi", F.when(F.col("_row") >= period, value)).drop("_step", "_row", "_gain", "_loss")


def drawdowns(bars: DataFrame) -> DataFrame:
    """Fall from the running peak; the peak starts at the second bar, the first with a return."""
    numbered = bars.withColumn("_row", F.row_number().over(by_symbol())).where("_row > 1")
    peak = F.max("close").over(running())
    return numbered.withColumn("drawdown", change(F.col("close"), peak)).drop("_row")


def max_drawdown(bars: DataFrame, segment: Column | None = None) -> DataFrame:
    """Worst fall from the running peak per symbol, the peak starting at the second bar.

    A symbol's series is read in segments (years, or any column that never falls with time) that are summed up as highest, lowest and
    worst fall, and the summaries are put together in order: a very long series spans tasks, and one task orders its few summaries.
    The very first bar is told from others only then, so each segment is summed up with and without its first.
    """
    c = F.col
    rows = bars.select("symbol", "trade_date", "close", (F.year("trade_date") if segment is None else segment).alias("_part"))
    inside = Window.partitionBy("symbol", "_part").orderBy("trade_date")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_rest", F.when(F.row_number().over(inside) > 1, c("close")))
    rows = rows.withColumns({f"_fall_{n}": change(c(n), F.max(n).over(upto)) for n in ("close", "_rest")})
    parts = rows.groupBy("symbol", "_part").agg(F.count("*").alias("_bars"), *(
        f.alias(f"{name}_{n}") for n in ("close", "_rest") for name, f in (("_high", F.max(n)), ("_low", F.min(n)), ("_fall", F.min(f"_fall_{n}")))))
    order = Window.partitionBy("symbol").orderBy("_part")
    first = F.row_number().over(order) == 1
    parts = parts.withColumns({n: F.when(first, c(f"{n}__rest")).otherwise(c(f"{n}_close")) for n in ("_high", "_low", "_fall")})
    before = F.max("_high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    worst = parts.withColumn("_worst", F.least("_fall", change(c("_low"), before)))
    return worst.groupBy("symbol").agg(F.min("_worst").alias("max_drawdown"), F.sum("_bars").alias("_bars")).where("_bars > 1").drop("_bars")


def dividend_changes(yearly: DataFrame) -> DataFrame:
    before = F.lag("total_dividend").over(by_symbol("year"))
    moved = yearly.withColumns({"prev_dividend": before, "prev_year": F.lag("year").over(by_symbol("year"))})
    gap = F.col("total_dividend") - F.col("prev_dividend")
    # Yearly sums of cents can be equal on paper and differ in the last bit.
    moved_by = F.round(gap, 9)
    direction = F.when(moved_by > 0, 1).when(moved_by == 0, 0).otherwise(-1)
    return moved.withColumns({
        "dividend_change": gap, "growth_rate": ratio(gap, F.col("prev_dividend")) * 100, "direction": direction
    })


def dividend_streaks(changes: DataFrame, break_on_gap: bool = True) -> DataFrame:
    """Years paid and years raised in a row, counted back from the newest year."""
    back = Window.partitionBy("symbol").orderBy(F.desc("year"))
    upto = back.rowsBetween(Window.unboundedPreceding, 0)
    newer = F.lag("year").over(back)
    skipped = newer.isNotNull() & (newer - F.col("year") != 1) if break_on_gap else F.lit(False)
    marked = changes.withColumns({
        "_unpaid": as_int(~(F.col("total_dividend") > 0) | skipped), "_not_raised": as_int(F.col("direction") != 1)
    })
    marked = marked.withColumns({"_u": F.sum("_unpaid").over(upto), "_r": F.sum("_not_raised").over(upto)})
    return marked.groupBy("symbol").agg(
        F.count_if(F.col("_u") == 0).alias("payment_streak_years"),
        F.count_if(F.col("_r") == 0).alias("increase_streak_years"),
        F.count("*").alias("total_years_paying"),
    )


def days_between(dividends: DataFrame) -> DataFrame:
    before = F.lag("ex_date").over(by_symbol("ex_date"))
    return dividends.withColumn("days_between", F.date_diff("ex_date", before))


def recent_base(bars: DataFrame, rows: int = 20) -> DataFrame:
    """High and low of the rows before today."""
    frame = by_symbol().rowsBetween(-rows, -1)
    return bars.withColumns({"recent_high": F.max("high").over(frame), "recent_low": F.min("low").over(frame)})


def accumulation(bars: DataFrame, since: Column) -> DataFrame:
    """Up-volume minus down-volume over all moved volume since a day."""
    step = F.col("close") - F.lag("close").over(by_symbol())
    moved = bars.withColumn("_signed", F.signum(step) * F.col("volume")).where(F.col("trade_date") >= since)
    return moved.groupBy("symbol").agg(
        ratio(F.sum("_signed"), F.sum(F.abs("_signed"))).alias("accumulation_ratio")
    )


def newest_rows(df: DataFrame, k: int, order: str = "trade_date") -> DataFrame:
    return top_per_group(df, ["symbol"], [F.desc(order)], k)


def sequences(rows: DataFrame, features: tuple[str, ...], target: str, length: int = 60, chunk: int = 240) -> DataFrame:
    """The ``length`` earlier feature rows of each row as one array, with the row's target.

    Rows are gathered in chunks of ``chunk`` with the ``length`` rows before them, and each sequence is a slice of its chunk: a row
    travels and is held once or twice, not ``length`` times. The output is ``length`` times its input, so it is meant to be written out.
    """
    number = F.row_number().over(by_symbol()) - 1
    entry = F.struct(F.col("_n"), F.struct("trade_date", *features).alias("f"), F.col(target).alias("t"))
    placed = rows.select("symbol", "trade_date", *features, *([target] if target not in features else []), number.alias("_n"))
    meant = F.sequence(F.floor(F.col("_n") / chunk), F.floor((F.col("_n") + length) / chunk))
    chunks = placed.select("symbol", F.explode(meant).alias("_chunk"), entry.alias("_e")).groupBy("symbol", "_chunk").agg(F.sort_array(F.collect_list("_e")).alias("_all"))
    whole = chunks.where(F.size("_all") > length).select("symbol", F.col("_all.f").alias("_f"), F.col("_all.t").alias("_t"))
    at = whole.select("symbol", "_f", "_t", F.explode(F.sequence(F.lit(length), F.size("_f") - 1)).alias("_i"))
    return at.select(
        "symbol", F.col("_f")[F.col("_i")]["trade_date"].alias("trade_date"), F.slice("_f", F.col("_i") - length + 1, length).alias("sequence"),
        F.col("_t")[F.col("_i")].alias("target"),
    )


def cross_section_volatility(returns: DataFrame, last: int = 20) -> DataFrame:
    """Mean over the newest days of the spread of returns within a day."""
    daily = returns.groupBy("trade_date").agg(F.stddev_samp("daily_return").alias("spread"))
    newest = daily.where(F.col("spread").isNotNull()).orderBy(F.desc("trade_date")).limit(last)
    return newest.agg(F.avg("spread").alias("market_vol"), F.count("*").alias("days"))
