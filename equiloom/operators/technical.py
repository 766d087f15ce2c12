"""Price-based scores: breakouts, risk, position sizing, forward returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from equiloom.functions.expressions import (
    as_int, change, clamp, holds, ladder, points, ratio, sample_kurtosis, sample_skew,
)
from equiloom.functions.frames import by_symbol, running, top_per_group, within
from equiloom.functions.ranking import numbered, tied_rank
from equiloom.operators.aggregates import win_loss
from equiloom.operators.filters import eligible_universe
from equiloom.operators.joins import nth_later, of_symbols
from equiloom.operators.series import daily_returns

RISK_FREE = 0.03  # annual
TRADING_DAYS = 252
DAILY_RISK_FREE = RISK_FREE / TRADING_DAYS
YEAR_ROWS, RSI_ROWS = 252, 14

BREAKOUT_WEIGHTS = {"proximity": 0.25, "volume": 0.25, "base_quality": 0.15, "momentum": 0.15,
                    "accumulation": 0.10, "relative_strength_score": 0.10}


def _newest(bars: DataFrame, listed: DataFrame, rows: int) -> DataFrame:
    """Newest rows of each listed symbol, numbered back from today, with their price step.

    A score of the last day needs no window over the whole history: trailing means and
    extremes are plain aggregates over the newest rows.
    """
    back = Window.partitionBy("symbol").orderBy(F.desc("trade_date"))
    stepped = of_symbols(bars, listed).withColumn("_step", F.col("close") - F.lead("close").over(back))
    return top_per_group(stepped, ["symbol"], [F.desc("trade_date")], rows)


def _span(first: int, last: int, value: str) -> Column:
    return F.when(F.col("row_no").between(first, last), F.col(value))


def breakout_score(bars: DataFrame, bench: DataFrame, universe: DataFrame, as_of: Column, scale: int = 1) -> DataFrame:
    """Six weighted parts per symbol; calendar look-backs are multiplied by ``scale``.

    A day has at most one row, so the newest rows of the longest look-back hold everything.
    """
    c = F.col
    traded = eligible_universe(universe, exclude_etf=True).select("symbol")
    newest = _newest(bars, traded, max(YEAR_ROWS, 90 * scale + 1))
    day = c("trade_date")

    def since(days: int) -> Column:
        return day >= F.date_sub(as_of, days * scale)

    signed = F.signum("_step") * c("volume")
    base = F.when(since(90), c("close"))
    before = day <= F.date_sub(as_of, 20 * scale)
    facts = newest.groupBy("symbol").agg(
        F.max(_span(1, 1, "close")).alias("close"), F.max(_span(1, YEAR_ROWS, "high")).alias("high_52w"),
        F.avg(_span(1, 50, "close")).alias("sma_50"), F.avg(_span(1, 200, "close")).alias("sma_200"),
        ratio(F.max(_span(1, 1, "volume")), F.avg(_span(1, 20, "volume"))).alias("volume_ratio"),
        F.max(day).alias("last_traded"), ratio(F.stddev_samp(base), F.avg(base)).alias("base_volatility"),
        F.count_if(since(10) & (c("_step") > 0)).alias("up_days"),
        ratio(F.sum(F.when(since(20), signed)), F.sum(F.when(since(20), F.abs(signed)))).alias("accumulation_ratio"),
        F.max_by(F.when(before, c("close")), F.when(before, day)).alias("_then"),
    ).where(c("last_traded") >= F.date_sub(as_of, 365))
    market_now = bench.agg(F.max_by("close", "trade_date")).scalar()
    market_then = bench.where(day <= F.date_sub(as_of, 20 * scale)).agg(F.max_by("close", "trade_date")).scalar()
    facts = facts.withColumns({
        "pct_of_high": ratio(c("close"), c("high_52w")),
        "relative_strength": change(c("close"), c("_then")) - change(market_now, market_then),
    })
    pct, surge, tight = c("pct_of_high"), c("volume_ratio"), c("base_volatility")
    parts = facts.withColumns({
        "proximity": points(pct, [(0.98, 100.0), (0.95, 80.0), (0.90, 60.0)],
                            F.greatest(F.lit(0.0), F.coalesce(pct, F.lit(0.0)) * 100 - 40)),
        "volume": points(surge, [(2.0, 100.0), (1.5, 80.0), (1.2, 60.0)], F.coalesce(surge * 50, F.lit(0.0))),
        "base_quality": points(tight, [(0.15, 100.0), (0.25, 80.0), (0.35, 60.0)],
                               F.greatest(F.lit(0.0), 100 - F.coalesce(tight, F.lit(0.5)) * 200), by="<="),
        "momentum": F.least(F.lit(100.0), c("up_days") * 15.0),
        "accumulation": F.coalesce(50 + c("accumulation_ratio") * 50, F.lit(50.0)),
        "relative_strength_score": F.coalesce(50 + clamp(c("relative_strength") * 500, -50, 50), F.lit(50.0)),
    })
    total = sum((c(n) * w for n, w in BREAKOUT_WEIGHTS.items()), F.lit(0.0))
    near, quiet = F.round(pct, 9), F.round(surge, 9)
    above = (c("close") > c("sma_50")) & (c("close") > c("sma_200"))
    scored = parts.withColumns({
        "breakout_score": F.round(total, 2),
        "has_breakout": holds((near >= 0.98) & (quiet >= 1.5) & (near <= 1.10) & above),
    }).where(c("breakout_score") > 0)
    strength = ladder(c("breakout_score"), [(40, "Weak"), (60, "Moderate"), (80, "Strong"), (100, "Very Strong")],
                      None, by="<=")
    return scored.select(
        "symbol", "breakout_score", "has_breakout", c("close").alias("current_price"), "high_52w",
        c("volume_ratio").alias("volume_surge"), "proximity", "volume", "base_quality",
        c("momentum").alias("momentum_score"), "accumulation", "relative_strength_score", "relative_strength",
        "accumulation_ratio", strength.alias("breakout_strength"),
    )


def rank_breakouts(scored: DataFrame) -> DataFrame:
    return numbered(scored, [F.desc("breakout_score"), F.asc("symbol")], "rank")


def technical_breakouts(bars: DataFrame, universe: DataFrame, minimum: int = 20, rows: int = 60) -> DataFrame:
    """Position, volume and trend flags of the newest bar, and the scores built from them."""
    c = F.col
    traded = eligible_universe(universe).select("symbol", "sector")
    gain, loss = F.greatest("_step", F.lit(0.0)), F.greatest(-c("_step"), F.lit(0.0))
    momentum = c("row_no") <= RSI_ROWS
    up, down = F.sum(F.when(momentum, gain)), F.sum(F.when(momentum, loss))
    last = _newest(bars, traded, YEAR_ROWS).groupBy("symbol", "sector").agg(
        F.count_if(c("row_no") <= rows).alias("_rows"), F.max("trade_date").alias("trade_date"),
        F.max(_span(1, 1, "close")).alias("close"), F.max("high").alias("high_52w"), F.min("low").alias("low_52w"),
        *[F.avg(_span(1, n, "close")).alias(f"sma_{n}") for n in (20, 50, 200)],
        ratio(F.max(_span(1, 1, "volume")), F.avg(_span(1, 20, "volume"))).alias("volume_ratio"),
        F.max(_span(2, 21, "high")).alias("recent_high"), F.min(_span(2, 21, "low")).alias("recent_low"),
        ratio(100 * up, up + down).alias("rsi"),
    ).where(c("_rows") >= minimum)
    above_high = F.coalesce(ratio(c("close"), F.when(c("high_52w") > 0, c("high_52w"))), F.lit(0.0))
    flags = last.withColumns({
        "price_vs_52w_high": above_high,
        "price_vs_52w_low": F.coalesce(ratio(c("close"), F.when(c("low_52w") > 0, c("low_52w"))), F.lit(0.0)),
        "volume_ratio": F.coalesce("volume_ratio", F.lit(1.0)),
        **{f"above_sma_{n}": holds(c("close") > c(f"sma_{n}")) for n in (20, 50, 200)},
    }).withColumns({
        "near_52w_high": F.round("price_vs_52w_high", 9) >= 0.98,
        "new_52w_high": F.round("price_vs_52w_high", 9) >= 1.0,
        "volume_surge": F.round("volume_ratio", 9) > 1.5,
        "base_breakout": holds(
            (ratio(c("recent_high") - c("recent_low"), c("recent_high")) < 0.15)
            & (c("recent_high") > c("recent_low")) & (c("close") > c("recent_high"))
        ),
        "momentum_surge": holds(F.round("rsi", 9) > 70),
    })

    def worth(flag: str, value: int) -> Column:
        return as_int(c(flag)) * value

    surge = F.when(c("volume_surge"), F.when(F.round("volume_ratio", 9) > 2.0, 25).otherwise(15)).otherwise(0)
    position = F.when(c("new_52w_high"), 30).when(c("near_52w_high"), 20).otherwise(0)
    breakout = (
        position + surge + worth("above_sma_20", 5) + worth("above_sma_50", 7) + worth("above_sma_200", 8)
        + worth("base_breakout", 15) + worth("momentum_surge", 10)
    )
    volume = F.when(c("volume_ratio") > 1, F.least(F.lit(100.0), c("volume_ratio") * 25)).otherwise(c("volume_ratio") * 50)
    trend = (
        worth("above_sma_200", 40) + worth("above_sma_50", 30) + worth("above_sma_20", 20)
        + as_int(c("sma_20") > c("sma_50")) * 10
    )
    scored = flags.withColumns({
        "breakout_strength": F.least(F.lit(100), breakout).cast("double"), "volume_strength": volume,
        "trend_strength": F.least(F.lit(100), trend).cast("double"),
    }).withColumn(
        "composite_score", c("breakout_strength") * 0.4 + c("volume_strength") * 0.3 + c("trend_strength") * 0.3
    )
    label = ladder(c("composite_score"), [(80, "STRONG"), (60, "MODERATE"), (40, "WEAK")], "NONE")
    return scored.select(
        "symbol", "sector", c("trade_date").alias("signal_date"), c("close").alias("latest_price"), "price_vs_52w_high",
        "price_vs_52w_low", "above_sma_20", "above_sma_50", "above_sma_200", "volume_ratio", "volume_surge",
        "near_52w_high", "new_52w_high", "base_breakout", "momentum_surge", "rsi", "breakout_strength", "volume_strength",
        "trend_strength", "composite_score", label.alias("signal_strength"),
    )


def stock_and_market_returns(bars: DataFrame, bench: DataFrame) -> DataFrame:
    """Stock return with the benchmark's change over the same two bars of the stock.

    The benchmark has one row per trading day, so broadcasting it is bounded by the calendar.
    """
    market = bench.select("trade_date", F.col("close").alias("market_close"))
    joined = daily_returns(bars.join(F.broadcast(market), "trade_date", "left"))
    return joined.withColumn("market_return", change(F.col("market_close"), F.lag("market_close").over(by_symbol())))


def risk_metrics(bars: DataFrame, bench: DataFrame, universe: DataFrame, as_of: Column, lookback_days: int = 252,
                 minimum: int = 20) -> DataFrame:
    """Return, volatility, tail and drawdown figures per symbol with a risk score and class."""
    c = F.col
    listed = eligible_universe(universe).select("symbol", "sector")
    recent = within(bars, "trade_date", lookback_days, as_of).select("symbol", "trade_date", "close")
    returns = stock_and_market_returns(of_symbols(recent, listed), bench).where(c("daily_return").isNotNull())
    rows = returns.withColumn("_dd", change(c("close"), F.max("close").over(running())))
    r = c("daily_return")
    annual = F.sqrt(F.lit(float(TRADING_DAYS)))
    downside = F.stddev_samp(F.when(r < 0, r)) * annual
    stats = rows.groupBy("symbol", "sector").agg(
        (F.avg(r) * TRADING_DAYS).alias("annual_return"), (F.stddev_samp(r) * annual).alias("annual_volatility"),
        sample_skew(r).alias("skewness"), sample_kurtosis(r).alias("kurtosis"),
        F.coalesce(ratio(F.avg(r) - DAILY_RISK_FREE, F.stddev_samp(r)) * annual, F.lit(0.0)).alias("sharpe_ratio"),
        ratio((F.avg(r) - DAILY_RISK_FREE) * TRADING_DAYS, downside).alias("sortino_ratio"),
        F.when(F.count("market_return") == F.count(r),
               ratio(F.covar_samp(r, "market_return"), F.var_samp("market_return"))).alias("beta"),
        F.min("_dd").alias("max_drawdown"), F.percentile(r, F.lit(0.05)).alias("var_95"),
        F.collect_list(r).alias("_returns"), F.count(r).alias("trading_days"),
        F.count_if(r > 0).alias("positive_days"), F.count_if(r < 0).alias("negative_days"),
        F.max("trade_date").alias("calculation_date"),
    ).where(c("trading_days") >= minimum)
    # The returns of one symbol are bounded by the calendar; the tail mean folds over them.
    tail = F.filter("_returns", lambda x: x <= c("var_95"))
    shortfall = F.aggregate(tail, F.lit(0.0), lambda acc, x: acc + x) / F.size(tail)
    rated = stats.withColumns({"cvar_95": shortfall, "win_rate": c("positive_days") / c("trading_days")}).drop("_returns")
    vol, fall, wins = (F.round(n, 9) for n in ("annual_volatility", "max_drawdown", "win_rate"))
    sharpe_points = F.when(c("sharpe_ratio") > 0, F.least(F.lit(25.0), c("sharpe_ratio") * 10)).otherwise(0.0)
    score = (
        50 + sharpe_points + F.when((vol < 0.2) & (vol > 0), 10).when(vol > 0.4, -10).otherwise(0)
        + F.when(fall == 0, 0).when(fall > -0.1, 10).when(fall < -0.3, -15).otherwise(0)
        + F.when(wins > 0.55, 5).when(wins < 0.45, -5).otherwise(0)
    )
    category = ladder(c("annual_volatility"), [(0.15, "LOW"), (0.25, "MODERATE"), (0.35, "HIGH")], "VERY_HIGH", by="<")
    return rated.withColumn("risk_adjusted_score", clamp(score)).withColumn("risk_category", category)


POSITIONS = [(0.08, "FULL"), (0.05, "LARGE"), (0.03, "MEDIUM"), (0.01, "SMALL")]
MAX_FRACTION, MAX_POSITION = 0.25, 0.10


def kelly(bars: DataFrame, universe: DataFrame, as_of: Column, scores: DataFrame | None = None,
          lookback_days: int = 252, minimum: int = 60) -> DataFrame:
    """Position size from win statistics: the smaller of two Kelly fractions, scaled by quality.

    ``scores`` has symbol and composite_score (and optionally the portfolio scores).
    """
    c = F.col
    listed = eligible_universe(universe).select("symbol")
    recent = within(bars, "trade_date", lookback_days, as_of).select("symbol", "trade_date", "close")
    stats = win_loss(daily_returns(of_symbols(recent, listed)), minimum)
    if scores is None:
        stats = stats.withColumn("composite_score", F.lit(None).cast("double"))
    else:
        stats = stats.join(scores, "symbol", "left")
    win = c("winning_trades") / c("total_trades")
    odds = F.coalesce(ratio(c("avg_win"), F.when(c("avg_loss") > 0, c("avg_loss"))), F.lit(0.0))
    excess = c("mean_return") - DAILY_RISK_FREE
    spread = F.when(c("std_dev") > 0, c("std_dev"))
    sized = stats.withColumns({"win_probability": win, "win_loss_ratio": odds}).withColumns({
        "standard_kelly": F.when(
            c("win_loss_ratio") > 0,
            ratio(c("win_probability") * c("win_loss_ratio") - (1 - c("win_probability")), c("win_loss_ratio")),
        ).otherwise(0.0),
        "continuous_kelly": F.coalesce(ratio(excess, spread * spread), F.lit(0.0)),
        "quality_multiplier": F.coalesce(
            ladder(c("composite_score"), [(80, 1.2), (60, 1.0), (40, 0.8)], 0.5), F.lit(1.0)),
    }).withColumn("raw_kelly", F.least("standard_kelly", "continuous_kelly"))
    adjusted = clamp(c("raw_kelly"), 0, MAX_FRACTION) * c("quality_multiplier")
    sized = sized.withColumn("adjusted_kelly", adjusted).withColumn(
        "final_kelly", F.least(F.lit(MAX_POSITION), c("adjusted_kelly")))
    category = ladder(c("final_kelly"), POSITIONS, F.when(c("final_kelly") > 0, "MINIMAL").otherwise("NONE"))
    kept = [n for n in ("value_score", "growth_score", "dividend_score") if n in stats.columns]
    return sized.select(
        "symbol", "total_trades", "winning_trades", F.round("win_probability", 4).alias("win_probability"),
        F.round(F.coalesce(c("avg_win") * 100, F.lit(0.0)), 4).alias("avg_win_pct"),
        F.round(F.coalesce(c("avg_loss") * 100, F.lit(0.0)), 4).alias("avg_loss_pct"),
        F.round("win_loss_ratio", 4).alias("win_loss_ratio"), F.round("standard_kelly", 4).alias("standard_kelly"),
        F.round("continuous_kelly", 4).alias("continuous_kelly"), F.round(c("raw_kelly") * 100, 2).alias("raw_kelly_pct"),
        F.round(c("adjusted_kelly") * 100, 2).alias("adjusted_kelly_pct"),
        F.round(c("final_kelly") * 100, 2).alias("final_position_pct"),
        F.round("std_dev", 6).alias("daily_volatility"),
        F.round(c("std_dev") * F.sqrt(F.lit(252.0)), 4).alias("annual_volatility"),
        F.round(F.coalesce(ratio(excess, spread) * F.sqrt(F.lit(252.0)), F.lit(0.0)), 4).alias("sharpe_ratio"),
        F.when(c("composite_score") != 0, c("composite_score")).otherwise(50.0).alias("quality_score"),
        "quality_multiplier", category.alias("position_category"), "composite_score", *kept,
    )


MONTH, QUARTER, HALF, YEAR = 21, 63, 126, 252


def _worst_of(first: Column, then: Column) -> Column:
    """Highest, lowest and worst fall of two stretches, one after the other; a stretch that is null adds nothing."""
    return F.struct(
        F.greatest(first["high"], then["high"]).alias("high"), F.least(first["low"], then["low"]).alias("low"),
        F.least(first["fall"], then["fall"], change(then["low"], first["high"])).alias("fall"),
    )


def forward_falls(rows: DataFrame, spans: dict[str, int], order) -> DataFrame:
    """Worst fall from a running peak over this row and the next ``n``, for each ``{name: n}``.

    Stretches of 1, 2, 4, ... rows are put together from two of half their length, and any other length from those, so a row
    reads a few rows ahead and holds no list. All steps share the order's one sort.
    """
    close, longest = F.col("close"), max(spans.values()) + 1
    rows = rows.withColumn("_s1", F.struct(close.alias("high"), close.alias("low"), F.lit(0.0).alias("fall")))
    size, made = 1, ["_s1"]
    while 2 * size <= longest:
        rows = rows.withColumn(f"_s{2 * size}", _worst_of(F.col(f"_s{size}"), F.lead(f"_s{size}", size).over(order)))
        size *= 2
        made.append(f"_s{size}")
    for name, n in spans.items():
        parts = [1 << bit for bit in range(size.bit_length()) if (n + 1) >> bit & 1][::-1]
        whole, reached = F.col(f"_s{parts[0]}"), parts[0]
        for part in parts[1:]:
            rows = rows.withColumn(name, _worst_of(whole, F.lead(f"_s{part}", reached).over(order)))
            whole, reached = F.col(name), reached + part
        rows = rows.withColumn(name, whole["fall"])
    return rows.drop(*made)


def forward_returns(bars: DataFrame) -> DataFrame:
    """Returns over the next 21 to 252 bars, and the next month's and quarter's risk."""
    c, order = F.col, by_symbol()
    horizons = {"return_1m": MONTH, "return_3m": QUARTER, "return_6m": HALF, "return_12m": YEAR}
    rows = daily_returns(bars.select("symbol", "trade_date", "close")).withColumns(
        {name: change(F.lead("close", n).over(order), c("close")) for name, n in horizons.items()}
    )
    spans = {"1m": MONTH, "3m": QUARTER}
    rows = forward_falls(rows, {f"_fall_{label}": n for label, n in spans.items()}, order)
    figures = {}
    for label, n in spans.items():
        frame = order.rowsBetween(1, n)
        figures |= {f"_spread_{label}": F.stddev_samp("daily_return").over(frame), f"_mean_{label}": F.avg("daily_return").over(frame)}
    rows = rows.withColumns(figures)
    for label in spans:
        full, spread = F.col(f"return_{label}").isNotNull(), c(f"_spread_{label}")
        rows = rows.withColumns({
            f"volatility_{label}": F.when(full, spread * F.sqrt(F.lit(252.0))),
            f"sharpe_{label}": F.when(full, ratio(c(f"_mean_{label}") - DAILY_RISK_FREE, spread) * F.sqrt(F.lit(252.0))),
            f"max_drawdown_{label}": F.when(full, c(f"_fall_{label}")),
        }).drop(f"_spread_{label}", f"_mean_{label}", f"_fall_{label}")
    return rows.drop("daily_return")


def benchmark_forward_returns(bench: DataFrame) -> DataFrame:
    """Percent change to the n-th later day when that day is near enough."""
    one = Window.partitionBy(F.lit(1)).orderBy("trade_date")
    spans = {"return_1m": (21, 35), "return_3m": (63, 100), "return_6m": (126, 200), "return_1y": (252, 380)}
    return bench.withColumns({
        name: F.when(F.col("close") > 0,
                     ratio(nth_later("close", "trade_date", n, days, one) - F.col("close"), F.col("close")) * 100)
        for name, (n, days) in spans.items()
    })


OUTPERFORMANCE_MONTHS = (1, 3, 6, 12, 36)


def outperformance(bars: DataFrame, bench: DataFrame, universe: DataFrame, as_of: Column) -> DataFrame:
    """Stock minus benchmark return at five horizons; the score is their plain mean."""
    c, listed = F.col, eligible_universe(universe).select("symbol")
    traded = bars.join(listed, "symbol", "left_semi").where(c("trade_date") <= as_of)

    def closes(months: int) -> Column:
        then = F.add_months(as_of, -months)
        return F.max_by(F.when(c("trade_date") <= then, c("close")), F.when(c("trade_date") <= then, c("trade_date")))

    picks = [F.max_by("close", "trade_date").alias("_now"),
             *[closes(m).alias(f"_then_{m}") for m in OUTPERFORMANCE_MONTHS]]
    stock = traded.groupBy("symbol").agg(*picks)
    market = bench.where(c("trade_date") <= as_of).agg(*picks)
    market_return = market.select(F.struct(
        *[change(c("_now"), c(f"_then_{m}")).alias(f"m{m}") for m in OUTPERFORMANCE_MONTHS])).scalar()
    rows = stock.select(
        "symbol", *[change(c("_now"), c(f"_then_{m}")).alias(f"stock_return_{m}m") for m in OUTPERFORMANCE_MONTHS],
        *[market_return[f"m{m}"].alias(f"market_return_{m}m") for m in OUTPERFORMANCE_MONTHS],
    )
    rows = rows.withColumns({
        f"relative_return_{m}m": c(f"stock_return_{m}m") - c(f"market_return_{m}m") for m in OUTPERFORMANCE_MONTHS
    })
    known = [c(f"relative_return_{m}m") for m in OUTPERFORMANCE_MONTHS]
    total = sum((F.coalesce(v, F.lit(0.0)) for v in known), F.lit(0.0))
    count = sum((as_int(v.isNotNull()) for v in known), F.lit(0))
    return rows.withColumn("outperformance_score", F.round(ratio(total, count), 6))


def rank_outperformance(rows: DataFrame) -> DataFrame:
    return tied_rank(rows, "outperformance_score", "symbol", "rank_composite")
