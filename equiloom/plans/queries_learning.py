"""Registered feature, training and prediction queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from equiloom.functions.frames import by_symbol
from equiloom.operators import learning
from equiloom.operators.series import forward_changes
from equiloom.plans.registry import add, view
from equiloom.session import stored

SCORES = ["value_score", "growth_score", "dividend_score", "momentum_score", "composite_score", "pe_ratio", "price_to_book", "dividend_yield"]
SECTOR_FLAGS = [f"sector_{s}" for s in ("technology", "energy", "industrials", "utilities", "consumer_staples")]


def targets(v) -> DataFrame:
    return forward_changes(v.bars.select("symbol", "trade_date", "close"), {"target": 21})


def features(v) -> DataFrame:
    return learning.ml_features(targets(v), v.score_history, SCORES, v.universe)


view("targets", "SELECT symbol, trade_date, lead(close, 21) OVER w / close - 1 AS target, close / lag(close, 21) OVER w - 1 AS past FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)")
add("g46_ml_features", "symbol trade_date target* " + " ".join(f"{s}*" for s in SCORES) + " market_cap_b* " + " ".join(SECTOR_FLAGS), features,
    "SELECT t.symbol, t.trade_date, target, " + ", ".join(f"coalesce({s}, 0) AS {s}" for s in SCORES) + ", market_cap / 1e9 AS market_cap_b, "
    + ", ".join(f"(sector = '{s[7:].replace('_', ' ').title()}')::int AS {s}" for s in SECTOR_FLAGS)
    + " FROM (SELECT * FROM targets WHERE target <> 0) t ASOF LEFT JOIN score_history h ON t.symbol = h.symbol AND t.trade_date >= h.signal_date JOIN universe u ON t.symbol = u.symbol")


def fitted(v) -> tuple:
    """Trained on the oldest days, held back by the following ones; the newest are left to predict."""
    parts = learning.split_by_date(stored(features(v), "features"))
    return learning.train_return_model(parts["train"], learning.feature_names(SCORES), parts["validation"], indicators=learning.indicator_names()), parts


def trained(v) -> DataFrame:
    model, parts = fitted(v)
    return learning.predict(model, parts["test"]).withColumn("finite", F.col("predicted").isNotNull() & ~F.isnan("predicted") & (F.abs("predicted") < 10))


def trained_facts(v) -> DataFrame:
    """What must hold of any fit: rows and days of each part, and a training error below that of the mean."""
    model, parts = fitted(v)
    rows = [learning.predict(model, df).select(F.lit(part).alias("part"), "trade_date", "target", "predicted") for part, df in parts.items()]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2])
    facts = every.groupBy("part").agg(
        F.count("*").alias("samples"), F.countDistinct("trade_date").alias("days"),
        (F.avg(F.pow(F.col("predicted") - F.col("target"), F.lit(2.0))) < F.var_pop("target")).alias("better"))
    shares = learning.importances(model, learning.feature_names(SCORES)).agg(F.abs(F.sum("importance") - 1) < 1e-6).scalar()
    return facts.select("part", "samples", "days", F.when(F.col("part") == "train", F.col("better")).alias("beats_mean"), shares.alias("importances_sum_to_one"))


view("ml_rows", """
SELECT t.symbol, t.trade_date, target FROM (SELECT * FROM targets WHERE target <> 0) t JOIN universe u ON t.symbol = u.symbol""")
view("ml_cuts", """
SELECT quantile_cont(epoch(trade_date) / 86400, 0.64) AS a, quantile_cont(epoch(trade_date) / 86400, 0.8) AS b FROM (SELECT DISTINCT trade_date FROM ml_rows)""")
add("g47_train_return_model", "symbol trade_date target* finite", trained,
    "SELECT symbol, trade_date, target, true AS finite FROM ml_rows, ml_cuts WHERE epoch(trade_date) / 86400 > b")
add("g47_training_facts", "part samples days beats_mean importances_sum_to_one", trained_facts, """
SELECT part, count(*) AS samples, count(DISTINCT trade_date) AS days, CASE WHEN part = 'train' THEN true END AS beats_mean, true AS importances_sum_to_one
FROM (SELECT *, CASE WHEN epoch(trade_date) / 86400 <= a THEN 'train' WHEN epoch(trade_date) / 86400 <= b THEN 'validation' ELSE 'test' END AS part FROM ml_rows, ml_cuts) GROUP BY part""")


def naive(v) -> DataFrame:
    """A momentum forecast: half the past month's return."""
    past = F.col("close") / F.lag("close", 21).over(by_symbol()) - 1
    return targets(v).withColumn("predicted", past * 0.5).where(F.col("predicted").isNotNull())


view("scored", "SELECT symbol, trade_date, target, past * 0.5 AS predicted FROM targets WHERE past IS NOT NULL")
add("g48_evaluate_predictions", "mse*9 rmse* mae* r2* directional_accuracy* samples median_error* p90_error*", lambda v: learning.evaluate_predictions(naive(v)), """
SELECT avg(e * e) AS mse, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, 1 - avg(e * e) / var_pop(target) AS r2, avg(((predicted > 0) = (target > 0))::int) AS directional_accuracy,
  count(*) AS samples, median(abs(e)) AS median_error, quantile_cont(abs(e), 0.9) AS p90_error FROM (SELECT *, predicted - target AS e FROM scored WHERE target IS NOT NULL)""")
add("g49_prediction_signals", "symbol trade_date predicted* predicted_return_pct* prediction_rank signal", lambda v: learning.prediction_signals(naive(v)), """
SELECT *, predicted * 100 AS predicted_return_pct, dense_rank() OVER (ORDER BY predicted DESC) AS prediction_rank, CASE WHEN predicted <= -0.05 THEN 'STRONG_SELL' WHEN predicted <= -0.02 THEN 'SELL'
  WHEN predicted <= 0.02 THEN 'HOLD' WHEN predicted <= 0.05 THEN 'BUY' ELSE 'STRONG_BUY' END AS signal
FROM (SELECT symbol, max(trade_date) AS trade_date, round(arg_max(predicted, trade_date), 6) AS predicted FROM scored GROUP BY 1)""")
W = "PARTITION BY symbol ORDER BY trade_date"
view("feature_rows", f"""
SELECT *, close / nullif(sma_20, 0) AS price_to_sma20, close / nullif(sma_50, 0) AS price_to_sma50, close / nullif(sma_200, 0) AS price_to_sma200, volume / nullif(vol20, 0) AS relative_volume,
  sd / close AS normalized_volatility, row_number() OVER ({W}) AS k FROM (SELECT *, (high - low) / open AS daily_range, (close - open) / open AS daily_return, volume * close AS dollar_volume,
    avg(close) OVER ({W} ROWS 19 PRECEDING) AS sma_20, avg(close) OVER ({W} ROWS 49 PRECEDING) AS sma_50, avg(close) OVER ({W} ROWS 199 PRECEDING) AS sma_200,
    avg(volume) OVER ({W} ROWS 19 PRECEDING) AS vol20, stddev_samp(close) OVER ({W} ROWS 19 PRECEDING) AS sd, lead(close, 21) OVER ({W}) / close - 1 AS return_1m,
    lead(close, 63) OVER ({W}) / close - 1 AS return_3m FROM bars) WHERE return_3m IS NOT NULL""")


def sequence_check(v) -> DataFrame:
    rows = learning.sequence_features(v.bars)
    total = F.aggregate("sequence", F.lit(0.0), lambda acc, x: acc + F.coalesce(x["normalized_volatility"], F.lit(0.0)) + x["daily_range"] + x["price_to_sma200"])
    return rows.select("symbol", "trade_date", "target", F.size("sequence").alias("steps"), F.col("sequence")[0]["relative_volume"].alias("first_volume"), total.alias("feature_sum"))


add("g50_sequence_features", "symbol trade_date target* steps first_volume* feature_sum*3", sequence_check, f"""
SELECT symbol, trade_date, return_1m AS target, 60 AS steps, first_volume, feature_sum FROM (SELECT *, lag(relative_volume, 60) OVER ({W}) AS first_volume,
  sum(coalesce(normalized_volatility, 0) + daily_range + price_to_sma200) OVER ({W} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS feature_sum FROM feature_rows) WHERE k > 60""")
add("g51_ensemble", "symbol trade_date predicted*", lambda v: learning.ensemble(naive(v), naive(v).withColumn("predicted", F.col("predicted") * F.col("predicted"))),
    "SELECT symbol, trade_date, predicted * 0.6 + predicted * predicted * 0.4 AS predicted FROM scored")
