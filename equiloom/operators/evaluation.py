"""Strategy returns, parameter search and performance attribution.

Strategies are evaluated by weights: a portfolio is picked at each rebalance date from
scores known by then, and its weighted daily return runs from the bar after the entry day.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window, functions as F

from equiloom.functions.expressions import compounded, ratio
from equiloom.functions.frames import top_per_group
from equiloom.operators.aggregates import concentration, share_of_total
from equiloom.operators.joins import as_of_join, in_period, of_symbols
from equiloom.operators.series import daily_returns
from equiloom.session import checkpointed

RISK_FREE = 0.03
FREQUENCIES = {"monthly": "INTERVAL 1 MONTH", "quarterly": "INTERVAL 3 MONTHS", "annual": "INTERVAL 1 YEAR", "weekly": "INTERVAL 7 DAYS"}
MONTHS = {"monthly": 1, "quarterly": 3, "annual": 12}


def rebalance_calendar(days: DataFrame, frequency: str = "quarterly") -> DataFrame:
    """Rebalance dates from the first trading day on, each with its entry day and the next one.

    ``days`` has one row per trading day. Everything here is bounded by the calendar.
    """
    span = days.agg(F.min("trade_date").alias("_a"), F.max("trade_date").alias("_z"))
    dates = span.select(F.explode(F.sequence("_a", "_z", F.expr(FREQUENCIES[frequency]))).alias("rebalance_date"))
    # A date that is no trading day enters on the first one after it.
    entered = as_of_entry(dates, days)
    order = Window.partitionBy(F.lit(1)).orderBy("rebalance_date")
    return entered.withColumn("period_no", F.row_number().over(order) - 1).withColumn(
        "next_entry", F.lead("entry_day").over(order))


def as_of_entry(dates: DataFrame, days: DataFrame) -> DataFrame:
    """The first trading day from each date on, in one backward pass over dates and days; dates after the last day have none and go.

    Both are bounded by the calendar, and so is the one window.
    """
    marks = dates.select(F.col("rebalance_date").alias("_d"), F.lit(None).cast("date").alias("_day")).unionByName(
        days.select(F.col("trade_date").alias("_d"), F.col("trade_date").alias("_day")).distinct())
    # A day stands before the dates it is the entry of.
    back = Window.partitionBy(F.lit(1)).orderBy(F.desc("_d"), F.col("_day").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    filled = marks.withColumns({"entry_day": F.last("_day", ignorenulls=True).over(back)}).where(F.col("_day").isNull())
    return filled.where(F.col("entry_day").isNotNull()).select(F.col("_d").alias("rebalance_date"), "entry_day")


def scores_at(calendar: DataFrame, scores: DataFrame, columns: list[str]) -> DataFrame:
    """Latest known scores of every symbol at every rebalance date."""
    dates = calendar.agg(F.array_sort(F.collect_set("rebalance_date"))).scalar()
    asked = scores.select("symbol").distinct().withColumn("rebalance_date", F.explode(dates))
    return as_of_join(asked, scores, "symbol", "rebalance_date", "signal_date", columns)


STRATEGY_SCORES = {"VALUE": "value_score", "GROWTH": "growth_score", "DIVIDEND": "dividend_score", "BALANCED": "composite_score"}


def pick_weights(scored: DataFrame, n: int = 10, size: str | None = None) -> DataFrame:
    """Top ``n`` per strategy and rebalance date, all strategies in one pass.

    Weights are equal, or shares of a size column. The result has at most ``n`` rows per
    strategy and date; it is stored, since returns and turnover both read it.
    """
    entries = [F.struct(F.lit(s).alias("strategy"), F.col(c).alias("score")) for s, c in STRATEGY_SCORES.items()]
    sizes = [size] if size else []
    rows = scored.select("symbol", "rebalance_date", *sizes, F.explode(F.array(*entries)).alias("_e")).select(
        "symbol", "rebalance_date", *sizes, "_e.*").where(F.col("score").isNotNull())
    order = [F.round("score", 8).desc(), F.asc("symbol")]
    top = top_per_group(rows, ["strategy", "rebalance_date"], order, n, "pick_no")
    if size is None:
        weighed = top.withColumn("weight", F.lit(1.0 / n))
    else:
        weighed = share_of_total(top.withColumn("_size", F.coalesce(size, F.lit(0.05))), ["strategy", "rebalance_date"], "_size")
    return checkpointed(weighed.select("strategy", "rebalance_date", "symbol", "score", "weight", "pick_no"))


def turnover(picks: DataFrame, calendar: DataFrame) -> DataFrame:
    """Sum of absolute weight changes at each rebalance; the first one buys everything."""
    numbered = picks.join(F.broadcast(calendar.select("rebalance_date", "period_no")), "rebalance_date")
    now = numbered.select("strategy", "symbol", "period_no", F.col("weight").alias("_w"))
    leaving = now.select("strategy", "symbol", (F.col("period_no") + 1).alias("period_no"), (-F.col("_w")).alias("_w"))
    last = calendar.agg(F.max("period_no")).scalar()
    net = now.unionByName(leaving).groupBy("strategy", "period_no", "symbol").agg(F.sum("_w").alias("_d"))
    moved = net.groupBy("strategy", "period_no").agg(F.sum(F.abs("_d")).alias("turnover"))
    return moved.where(F.col("period_no") <= last)


def held_returns(bars: DataFrame, calendar: DataFrame, days: DataFrame) -> DataFrame:
    """Daily returns with the period they are earned in: after its entry day, up to the next."""
    periods = calendar.where(F.col("next_entry").isNotNull()).select(
        "period_no", F.col("entry_day").alias("period_start"), F.col("next_entry").alias("period_end"))
    moved = daily_returns(bars.select("symbol", "trade_date", "close")).where(F.col("daily_return").isNotNull())
    return in_period(moved, periods, days, open_start=True).select("symbol", "trade_date", "period_no", "daily_return")


def strategy_returns(picks: DataFrame, bars: DataFrame, calendar: DataFrame, days: DataFrame,
                     cost_bps: float = 20.0) -> DataFrame:
    """Daily weighted return per strategy, less turnover cost on the first day of a period.

    The picks are ``n`` rows per rebalance date and strategy; whether they are broadcast to the price table is left to their size.
    """
    held = picks.select("strategy", "rebalance_date", "symbol", "weight").join(
        F.broadcast(calendar.select("rebalance_date", "period_no")), "rebalance_date").drop("rebalance_date")
    moved = held_returns(bars, calendar, days)
    daily = moved.join(held, ["symbol", "period_no"]).groupBy("strategy", "period_no", "trade_date").agg(
        F.sum(F.col("weight") * F.col("daily_return")).alias("gross_return"))
    first = daily.groupBy("strategy", "period_no").agg(F.min("trade_date").alias("trade_date"))
    charges = first.join(turnover(picks, calendar), ["strategy", "period_no"]).select(
        "strategy", "period_no", "trade_date", (F.col("turnover") * cost_bps / 10_000).alias("cost"))
    charged = daily.join(charges, ["strategy", "period_no", "trade_date"], "left").withColumn("cost", F.coalesce("cost", F.lit(0.0)))
    return charged.withColumn("net_return", F.col("gross_return") - F.col("cost"))


def performance_stats(returns: DataFrame, value: str = "net_return") -> DataFrame:
    """Total and annual return, risk and win rate per strategy (population deviation)."""
    r, c = F.col(value), F.col
    run = Window.partitionBy("strategy").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    grown = returns.withColumn("_g", F.sum(F.log1p(r)).over(run))
    rows = grown.withColumn("_dd", F.exp(c("_g") - F.max("_g").over(run)) - 1)
    root = F.sqrt(F.lit(252.0))
    stats = rows.groupBy("strategy").agg(
        compounded(r).alias("total_return"), F.count("*").alias("days"), (F.stddev_pop(r) * root).alias("volatility"),
        F.coalesce(ratio(F.avg(r) - RISK_FREE / 252, F.stddev_pop(r)) * root, F.lit(0.0)).alias("sharpe_ratio"),
        F.min("_dd").alias("max_drawdown"), F.avg((r > 0).cast("int")).alias("win_rate"),
    )
    return stats.withColumn("annual_return", F.pow(1 + c("total_return"), F.lit(252.0) / c("days")) - 1)


# Search space per strategy: the first parameters shape the score, the last two the portfolio.
SCORE_GRID = {
    "VALUE": {"pe_weight": (0.2, 0.3, 0.4), "pb_weight": (0.1, 0.2, 0.3), "cash_flow_weight": (0.2, 0.3, 0.4),
              "fscore_threshold": (5, 6, 7)},
    "GROWTH": {"revenue_growth_weight": (0.2, 0.3, 0.4), "earnings_growth_weight": (0.2, 0.3, 0.4),
               "momentum_weight": (0.1, 0.2, 0.3), "quality_threshold": (60, 70, 80)},
    "DIVIDEND": {"yield_weight": (0.3, 0.4, 0.5), "growth_weight": (0.2, 0.3, 0.4), "payout_ratio_max": (0.5, 0.6, 0.7),
                 "min_years": (5, 10, 15)},
    "BALANCED": {"value_weight": (0.25, 0.33, 0.4), "growth_weight": (0.25, 0.33, 0.4), "quality_weight": (0.2, 0.34, 0.4),
                 "momentum_weight": (0.0, 0.1, 0.2)},
}
PORTFOLIO_GRID = {
    "VALUE": ((8, 10, 12, 15), ("monthly", "quarterly")), "GROWTH": ((8, 10, 12, 15), ("monthly", "quarterly")),
    "DIVIDEND": ((10, 15, 20), ("quarterly", "annual")), "BALANCED": ((15, 20, 25), ("monthly", "quarterly")),
}


def grid_columns(strategy: str, combo: Column) -> dict[str, Column]:
    """Parameter values of a combination number, read off as digits of a mixed-radix number."""
    out, step = {}, 1
    for name, values in reversed(SCORE_GRID[strategy].items()):
        place = F.floor(combo / step) % len(values)
        out[name] = F.element_at(F.array(*[F.lit(float(v)) for v in values]), place.cast("int") + 1)
        step *= len(values)
    return out


def _cheapness(name: str, top: float) -> Column:
    return F.when(F.col(name) > 0, F.least(F.lit(100.0), ratio(F.lit(top), F.col(name))))


def score_parts(strategy: str) -> dict[str, Column]:
    """What the score takes from a row, worked out before combinations multiply the rows; ``_limit`` is held against a threshold."""
    c = F.col

    def growth(name: str) -> Column:
        # ``least`` passes over nulls; unknown growth scores nothing.
        return F.when(c(name).isNotNull(), F.least(F.lit(100.0), c(name) * 2))

    if strategy == "VALUE":
        return {"_a": _cheapness("pe_ratio", 1000.0), "_b": _cheapness("price_to_book", 10.0), "_c": c("value_score"), "_limit": c("fscore")}
    if strategy == "GROWTH":
        return {"_a": growth("revenue_growth"), "_b": growth("earnings_growth"), "_c": c("momentum_score"), "_limit": F.round("composite_score", 9)}
    if strategy == "DIVIDEND":
        paid = F.when(c("dividend_yield") > 0, F.least(F.lit(100.0), c("dividend_yield") * 20))
        return {"_a": paid, "_b": c("dividend_score"), "_limit": F.round("payout_ratio", 9)}
    return {"_a": c("value_score"), "_b": c("growth_score"), "_c": c("composite_score"), "_d": c("momentum_score")}


#: The threshold of a strategy's grid, the test it makes of ``_limit``, and what is left of the score then.
LIMITS = {
    "VALUE": ("fscore_threshold", lambda value, limit: value < limit, 0.5), "GROWTH": ("quality_threshold", lambda value, limit: value < limit, 0.7),
    "DIVIDEND": ("payout_ratio_max", lambda value, limit: value > limit, 0.6),
}


def grid_score(strategy: str) -> Column:
    """The score of a row with the columns of ``score_parts`` and the values of a combination."""
    weights = [w for w in SCORE_GRID[strategy] if w.endswith("_weight")]
    total = reduce(Column.__add__, [F.coalesce(F.col(part) * F.col(w), F.lit(0.0)) for part, w in zip(("_a", "_b", "_c", "_d"), weights, strict=False)])
    if strategy not in LIMITS:
        return total
    name, test, share = LIMITS[strategy]
    return total * F.when(test(F.col("_limit"), F.col(name)), share).otherwise(1.0)


def contenders(signals: DataFrame, strategy: str) -> DataFrame:
    """Rows that some combination may pick: of those of a date with equal parts, tied under every combination, the first symbols, as many as the largest portfolio."""
    parts = score_parts(strategy)
    if strategy in LIMITS:
        name, test, _ = LIMITS[strategy]
        # Thresholds rise, so the number of those met tells which.
        limit = parts["_limit"]
        parts["_limit"] = sum((F.when(test(limit, F.lit(float(t))), 1).otherwise(0) for t in SCORE_GRID[strategy][name]), F.lit(0))
    first = top_per_group(signals.withColumns(parts), ["rebalance_date", *parts], [F.asc("symbol")], max(PORTFOLIO_GRID[strategy][0]), "_place")
    return first.drop(*parts, "_place")


def parameter_grid_scores(signals: DataFrame, strategy: str) -> DataFrame:
    """Score of every signal row under every score-parameter combination, numbered with the last parameter varying fastest.

    The fan-out is a generator over a fixed number of combinations, not a join.
    """
    names, parts = list(SCORE_GRID[strategy]), score_parts(strategy)
    combos = [F.struct(F.lit(i).alias("combo"), *[F.lit(float(v)).alias(n) for n, v in zip(names, values, strict=True)])
              for i, values in enumerate(product(*SCORE_GRID[strategy].values()))]
    rows = signals.withColumns(parts).select("*", F.inline(F.array(*combos)))
    return rows.withColumn("score", grid_score(strategy)).drop(*parts)


def grid_picks(scored: DataFrame, strategy: str) -> DataFrame:
    """The best symbols of every parameter combination at every rebalance date, enough for the largest portfolio; the smaller ones are its first.

    Symbols are dealt to twice as many slots as are picked. The best rows of the slots are as many different rows, so no pick scores less than
    the last one of the best ``n`` of them. Only rows that reach it are sorted, some ``1.4 n`` a combination and date however many symbols there are.
    """
    order, n = [F.round("score", 8).desc(), F.asc("symbol")], max(PORTFOLIO_GRID[strategy][0])
    keys, rows = ["rebalance_date", "combo"], scored.select("rebalance_date", "combo", "symbol", "score")
    slots = rows.groupBy(*keys, F.pmod(F.xxhash64("symbol"), F.lit(2 * n)).alias("_slot")).agg(F.max("score").alias("_best")).where(F.col("_best") > 0)
    # At most 2 n slots a combination and date: a table of the calendar's size. Scores that are equal when rounded are within 1e-8, and only positive ones count.
    last = F.get(F.sort_array(F.collect_list("_best"), asc=False), F.lit(n - 1))
    least = slots.groupBy(*keys).agg(F.greatest(last - 2e-8, F.lit(5e-324)).alias("_least"))
    reach = rows.join(F.broadcast(least), keys).where(F.col("score") >= F.col("_least"))
    best = top_per_group(reach, keys, order, n, "pick_no")
    return checkpointed(best.select("rebalance_date", "combo", "symbol", "pick_no"))


def picked_returns(picks: list[DataFrame], bars: DataFrame, calendar: DataFrame, days: DataFrame) -> DataFrame:
    """Daily returns of the symbols that some combination of some strategy holds."""
    symbols = reduce(DataFrame.unionByName, [p.select("symbol") for p in picks]).distinct()
    return held_returns(bars.join(symbols, "symbol", "left_semi"), calendar, days)


def grid_daily_returns(picks: DataFrame, moved: DataFrame, calendar: DataFrame, strategy: str) -> DataFrame:
    """Daily return of every parameter combination over the whole history.

    ``calendar`` is monthly, and so are the periods of ``moved``; a slower strategy keeps each pick for several months. A rebalance date depends on no
    window, so every day is computed once per combination and frequency.
    """
    sizes, frequencies = PORTFOLIO_GRID[strategy]
    counts = picks.groupBy("rebalance_date", "combo").agg(F.count("*").alias("_picked"))
    numbered = picks.join(counts, ["rebalance_date", "combo"]).join(
        F.broadcast(calendar.select("rebalance_date", "period_no")), "rebalance_date")
    spans = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(MONTHS[f]).alias("m")) for f in frequencies])
    held = numbered.select("combo", "symbol", "pick_no", "_picked", "period_no", F.explode(spans).alias("_s")).where(
        F.col("period_no") % F.col("_s.m") == 0)
    held = held.select(
        "combo", "symbol", "pick_no", "_picked", F.col("_s.f").alias("rebalance_freq"),
        F.explode(F.sequence("period_no", F.col("period_no") + F.col("_s.m") - 1)).alias("period_no"))
    joined = held.join(moved, ["symbol", "period_no"])

    def portfolio(n: int) -> Column:
        gained = F.sum(F.when(F.col("pick_no") <= n, F.col("daily_return")).otherwise(0.0))
        return gained / F.least(F.lit(n), F.first("_picked"))

    wide = joined.groupBy("combo", "rebalance_freq", "trade_date").agg(*[portfolio(n).alias(str(n)) for n in sizes])
    long = wide.unpivot(["combo", "rebalance_freq", "trade_date"], [str(n) for n in sizes], "num_stocks", "daily_return")
    return long.withColumn("num_stocks", F.col("num_stocks").cast("int"))


def walk_windows(days: DataFrame, train_months: int = 12, test_months: int = 3, step_months: int = 3) -> DataFrame:
    """Train and test windows stepped over the calendar; a handful of rows."""
    span = days.agg(F.min("trade_date").alias("_a"), F.max("trade_date").alias("_z"))
    starts = span.select("_a", "_z", F.explode(F.sequence("_a", "_z", F.expr(f"INTERVAL {step_months} MONTHS"))).alias("train_start"))
    middle = F.add_months("train_start", train_months)
    windows = starts.withColumn("train_end", middle).where(F.col("train_end") < F.col("_z"))
    return windows.withColumn("test_end", F.least(F.add_months("train_end", test_months), "_z")).select(
        "train_start", "train_end", F.col("train_end").alias("test_start"), "test_end")


def window_pieces(windows: DataFrame) -> DataFrame:
    """The stretches between any two neighbouring starts or ends of the windows; each window is some of them in a row."""
    ends = windows.select(F.explode(F.array("train_start", "train_end", "test_start", "test_end")).alias("period_start")).distinct()
    order = Window.partitionBy(F.lit(1)).orderBy("period_start")  # a few rows a year
    return ends.withColumn("period_end", F.lead("period_start").over(order)).where(F.col("period_end").isNotNull())


def return_moments(returns: DataFrame, windows: DataFrame, days: DataFrame, keys: list[str]) -> DataFrame:
    """Days, growth, mean and squared deviation of the returns of each key in each piece: one aggregate over all days, for all windows."""
    r = F.col("daily_return")
    inside = in_period(returns, window_pieces(windows), days)
    return inside.groupBy(*keys, F.col("period_start").alias("piece")).agg(
        F.count(r).alias("n"), F.product(1 + r).alias("growth"), F.avg(r).alias("mean"), (F.var_pop(r) * F.count(r)).alias("squares")).where("n > 0")


def _window_sharpe(moments: DataFrame, windows: DataFrame, start: str, end: str, keys: list[str], prefix: str) -> DataFrame:
    """Return and Sharpe ratio of each key in each window, from the moments of the window's pieces."""
    c = F.col
    pieces = window_pieces(windows).agg(F.array_sort(F.collect_set("period_start"))).scalar()
    spans = windows.select("train_start", start, end, pieces.alias("_p")).select(
        "train_start", F.explode(F.filter("_p", lambda p: (p >= c(start)) & (p < c(end)))).alias("piece"))
    parts = moments.join(F.broadcast(spans), "piece").groupBy("train_start", *keys).agg(
        (F.product("growth") - 1).alias("_total"), F.sum("n").alias("_days"), (F.sum(c("n") * c("mean")) / F.sum("n")).alias("_mean"),
        F.collect_list(F.struct("n", "mean", "squares")).alias("_parts"))
    squares = F.aggregate("_parts", F.lit(0.0), lambda total, p: total + p["squares"] + p["n"] * (p["mean"] - c("_mean")) * (p["mean"] - c("_mean")))
    facts = parts.withColumn("_vol", F.sqrt(squares / c("_days")) * F.sqrt(F.lit(252.0)))
    annual = F.pow(1 + c("_total"), F.lit(252.0) / c("_days")) - 1
    sharpe = F.coalesce(ratio(annual - RISK_FREE, F.when(F.round("_vol", 12) > 0, c("_vol"))), F.lit(0.0))
    return facts.select("train_start", *keys, c("_total").alias(f"{prefix}_return"), F.round(sharpe, 6).alias(f"{prefix}_sharpe"))


def walk_forward(returns: DataFrame, windows: DataFrame, days: DataFrame, strategy: str) -> DataFrame:
    """Best training parameters per window and how they did on the following test window."""
    keys = ["combo", "num_stocks", "rebalance_freq"]
    # Combinations x pieces: fixed by the grid and the calendar.
    moments = checkpointed(return_moments(returns, windows, days, keys))
    trained = _window_sharpe(moments, windows, "train_start", "train_end", keys, "train")
    best = F.max_by(F.struct(*keys, "train_return", "train_sharpe"),
                    F.struct("train_sharpe", -F.col("combo"), -F.col("num_stocks"), F.col("rebalance_freq") == min(PORTFOLIO_GRID[strategy][1])))
    chosen = trained.groupBy("train_start").agg(best.alias("_b")).select("train_start", "_b.*")
    tested = _window_sharpe(moments, windows, "test_start", "test_end", keys, "test")
    rows = windows.join(chosen, "train_start").join(tested, ["train_start", *keys], "left")
    rows = rows.withColumn("test_sharpe", F.coalesce("test_sharpe", F.lit(0.0))).withColumns(grid_columns(strategy, F.col("combo")))
    gap = F.col("train_sharpe") - F.col("test_sharpe")
    return checkpointed(rows.withColumns({"sharpe_degradation": gap, "parameter_stability": F.abs(gap)}))


def parameters_json(best: DataFrame, strategy: str) -> DataFrame:
    fields = [*SCORE_GRID[strategy], "num_stocks", "rebalance_freq"]
    return best.select(F.lit(strategy).alias("strategy"), "train_start", F.to_json(F.struct(*fields)).alias("best_params"))


def parameters_from_json(rows: DataFrame, strategy: str) -> DataFrame:
    shape = ", ".join([f"{n} double" for n in SCORE_GRID[strategy]] + ["num_stocks int", "rebalance_freq string"])
    return rows.where(F.col("strategy") == strategy).select("strategy", "train_start", F.from_json("best_params", shape).alias("p")).select("strategy", "train_start", "p.*")


def parameter_stability(best: DataFrame, strategy: str) -> tuple[DataFrame, DataFrame]:
    """How steady the chosen parameters are: numeric ones, then categorical ones."""
    c = F.col
    names = [*SCORE_GRID[strategy], "num_stocks"]
    values = best.select(*[c(n).cast("double") for n in names]).unpivot([], names, "parameter", "v")
    numeric = values.groupBy("parameter").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min_value"), F.max("v").alias("max_value"),
        F.count("*").alias("windows"),
    ).where(c("windows") > 1)
    cv = F.coalesce(ratio(c("std"), c("mean")), F.lit(0.0))
    numeric = numeric.withColumns({"cv": cv, "stable": (c("mean") != 0) & (F.round(cv, 9) < 0.3)})
    labels = best.groupBy(c("rebalance_freq").alias("mode")).agg(F.count("*").alias("_n"))
    total = best.agg(F.count("*")).scalar()
    top = labels.orderBy(F.desc("_n"), "mode").limit(1)
    share = c("_n") / total
    categorical = top.select(F.lit("rebalance_freq").alias("parameter"), "mode", share.alias("consistency"),
                             (F.round(share, 9) > 0.6).alias("stable"))
    return numeric, categorical


def position_values(trades: DataFrame, bars: DataFrame, universe: DataFrame) -> DataFrame:
    """Bought shares per day and symbol with price, sector, value and return of the day."""
    bought = trades.where(F.col("trade_type") == "BUY").groupBy("trade_date", "symbol").agg(F.sum("quantity").alias("shares"))
    moved = daily_returns(bars.select("symbol", "trade_date", "close"))
    priced = of_symbols(moved, universe.select("symbol", "sector")).select(
        "symbol", "trade_date", "sector", F.col("close").alias("price"), F.coalesce("daily_return", F.lit(0.0)).alias("daily_return"))
    return bought.join(priced, ["trade_date", "symbol"]).withColumn("market_value", F.col("shares") * F.col("price"))


def positions(values: DataFrame, bars: DataFrame) -> DataFrame:
    """Position values with their weight of the day and the mean return of all symbols that day."""
    moved = daily_returns(bars.select("symbol", "trade_date", "close"))
    market = moved.groupBy("trade_date").agg(F.avg(F.coalesce("daily_return", F.lit(0.0))).alias("market_return"))
    return share_of_total(values, ["trade_date"], "market_value").join(F.broadcast(market), "trade_date")


def brinson_effects(held: DataFrame) -> DataFrame:
    """Allocation, selection and interaction per day and sector against equal sector weights."""
    c = F.col
    # One row per (day, sector), stored: weights, sector count and mean all read it.
    cells = checkpointed(held.groupBy("trade_date", "sector").agg(
        F.sum("market_value").alias("_mv"), F.avg("daily_return").alias("_r")))
    weighed = share_of_total(cells, ["trade_date"], "_mv")
    benchmark = 1.0 / cells.agg(F.countDistinct("sector")).scalar()
    mean = cells.agg(F.avg("_r")).scalar()
    return weighed.select(
        "trade_date", "sector", ((c("weight") - benchmark) * c("_r")).alias("allocation_effect"),
        (benchmark * (c("_r") - mean)).alias("selection_effect"),
        ((c("weight") - benchmark) * (c("_r") - mean)).alias("interaction_effect"))


EFFECTS = ("allocation_effect", "selection_effect", "interaction_effect")


def brinson(held: DataFrame) -> DataFrame:
    """Effects by sector plus a total row."""
    effects = brinson_effects(held)
    sums = [F.sum(e).alias(e) for e in EFFECTS]
    by_sector = effects.groupBy("sector").agg(*sums)
    total = by_sector.agg(*sums).withColumn("sector", F.lit("TOTAL"))
    both = by_sector.unionByName(total)
    return both.withColumn("total_effect", sum((F.col(e) for e in EFFECTS), F.lit(0.0)))


FACTORS = ("value_factor", "growth_factor", "momentum_factor", "quality_factor")


def factor_attribution(held: DataFrame) -> DataFrame:
    """Exposure and return spread per factor; ``held`` carries the factor columns.

    A factor has one value per symbol, so positions are first summed by (factor, value) on every task; medians and
    averages follow from that small table.
    """
    c = F.col
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), c(f).alias("value")) for f in FACTORS)))
    by_value = checkpointed(held.select("daily_return", pairs.alias("p")).select("daily_return", "p.*").groupBy("factor", "value").agg(F.count("value").alias("n"), F.sum("daily_return").alias("gained")))
    whole = Window.partitionBy("factor")
    ahead = whole.orderBy(c("value").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = by_value.withColumns({"before": F.coalesce(F.sum("n").over(ahead), F.lit(0)), "all": F.sum("n").over(whole)})

    def at(place: Column) -> Column:
        return F.max(F.when((c("before") <= place) & (place < c("before") + c("n")), c("value"))).over(whole)

    rows = rows.withColumn("median", (at(F.floor((c("all") - 1) / 2)) + at(F.ceil((c("all") - 1) / 2))) / 2)

    def average(where: Column) -> Column:
        return F.coalesce(F.try_divide(F.sum(F.when(where, c("gained"))), F.sum(F.when(where, c("n")))), F.lit(0.0))

    facts = rows.groupBy("factor").agg(
        F.try_divide(F.sum(c("n") * c("value")), F.sum("n")).alias("exposure"),
        (average(c("value") > c("median")) - average(c("value") <= c("median"))).alias("factor_return"))
    return facts.withColumn("contribution", c("exposure") * c("factor_return"))


def risk_attribution(held: DataFrame) -> DataFrame:
    """Volatility times weight per position and sector; one long table."""
    root, r = F.sqrt(F.lit(252.0)), F.stddev_samp("daily_return")
    position = held.groupBy("symbol").agg((r * root).alias("volatility"), F.avg("weight").alias("weight")).select(
        F.lit("position").alias("level"), F.col("symbol").cast("string").alias("name"), "volatility", "weight")
    sector = held.groupBy("sector").agg((r * root).alias("volatility"), F.sum("weight").alias("weight")).select(
        F.lit("sector").alias("level"), F.col("sector").alias("name"), "volatility", "weight")
    both = position.unionByName(sector)
    return both.withColumn("risk_contribution", F.coalesce(F.col("volatility") * F.col("weight"), F.lit(0.0)))


def position_concentration(held: DataFrame) -> DataFrame:
    return concentration(held.groupBy("symbol").agg(F.avg("weight").alias("weight")))


def timing_attribution(held: DataFrame, periods: DataFrame, days: DataFrame) -> DataFrame:
    """Actual against buy-and-hold growth in each rebalance period."""
    r = F.col("daily_return")
    keys = ["period_start", "period_end"]
    inside = in_period(held.select("symbol", "trade_date", "daily_return"), periods, days)
    # Products as sums of logs: one partial row per symbol and period leaves each task.
    per_symbol = inside.groupBy(*keys, "symbol").agg(F.avg(r).alias("_mean"), F.sum(F.log1p(r)).alias("_log"))
    return per_symbol.groupBy(*keys).agg(
        (F.exp(F.sum(F.log1p("_mean"))) - 1).alias("buy_hold_return"), (F.exp(F.sum("_log")) - 1).alias("actual_return"),
    ).withColumn("timing_effect", F.col("actual_return") - F.col("buy_hold_return"))


def portfolio_daily(held: DataFrame) -> DataFrame:
    return held.groupBy("trade_date").agg(
        F.sum(F.col("weight") * F.col("daily_return")).alias("portfolio"), F.max("market_return").alias("benchmark"))


def alpha_beta(daily: DataFrame, minimum: int = 20) -> DataFrame:
    """Regression figures of daily portfolio on benchmark returns; defaults below ``minimum`` days."""
    c, root = F.col, F.sqrt(F.lit(252.0))
    both = daily.where(c("portfolio").isNotNull() & c("benchmark").isNotNull())
    facts = both.agg(
        F.count("*").alias("days"), F.coalesce(ratio(F.covar_samp("portfolio", "benchmark"), F.var_samp("benchmark")), F.lit(1.0)).alias("_b"),
        (F.avg("portfolio") * 252).alias("_p"), (F.avg("benchmark") * 252).alias("_m"),
        F.pow(F.corr("portfolio", "benchmark"), F.lit(2.0)).alias("_r2"),
        (F.stddev_samp(c("portfolio") - c("benchmark")) * root).alias("_te"),
    )
    enough, alpha = c("days") >= minimum, c("_p") - c("_b") * c("_m")
    return facts.select(
        F.when(enough, alpha).otherwise(0.0).alias("alpha"), F.when(enough, c("_b")).otherwise(1.0).alias("beta"),
        F.when(enough, c("_r2")).otherwise(0.0).alias("r_squared"), F.when(enough, c("_te")).alias("tracking_error"),
        F.when(enough, ratio(alpha, c("_te"))).alias("information_ratio"))


def attribution_report(held: DataFrame) -> DataFrame:
    """One summary row; every part is a single row read as scalar subqueries."""
    held = checkpointed(held)  # five parts read it
    daily = portfolio_daily(held)
    growth = daily.agg(compounded(F.col("portfolio")).alias("total_return"), compounded(F.col("benchmark")).alias("benchmark_return"))
    parts = [alpha_beta(daily), brinson(held).where("sector = 'TOTAL'").drop("sector"), position_concentration(held)]
    row = growth.withColumn("excess_return", F.col("total_return") - F.col("benchmark_return"))
    for part in parts:
        found = part.select(F.struct(*part.columns)).scalar()
        row = row.withColumns({name: found[name] for name in part.columns})
    return row
