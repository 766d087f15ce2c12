"""Feature tables, model training and prediction scoring on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from math import floor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import RobustScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from equiloom.functions.expressions import ladder, ratio
from equiloom.functions.frames import latest_by
from equiloom.functions.ranking import exact_quantiles, tied_rank
from equiloom.operators.joins import as_of_series, of_symbols
from equiloom.operators.series import forward_changes, moving_averages, rolling_volatility, sequences, volume_ratio
from equiloom.session import stored

RISK_CODES = {"SAFE": 0, "GREY": 1, "DISTRESS": 2}
SECTORS = (  # fixed sector classification
    "Technology", "Healthcare", "Financials", "Consumer Discretionary", "Consumer Staples", "Industrials", "Energy",
    "Utilities", "Materials", "Real Estate", "Communication Services",
)


def one_hot(column: str, values: tuple[str, ...], prefix: str) -> dict[str, Column]:
    """Indicator columns for fixed values, with one for a missing value."""
    named = {f"{prefix}_{v.lower().replace(' ', '_')}": F.col(column).eqNullSafe(v).cast("int") for v in values}
    return named | {f"{prefix}_missing": F.col(column).isNull().cast("int")}


def ordinal(column: str, codes: dict[str, int], default: int = 1) -> Column:
    code = F.lit(None).cast("int")
    for label, value in codes.items():
        code = F.when(F.col(column) == label, value).otherwise(code)
    return F.coalesce(code, F.lit(default))


def ml_features(targets: DataFrame, scores: DataFrame, score_columns: list[str], universe: DataFrame) -> DataFrame:
    """Targets with the scores known on their day, sector indicators and no missing values."""
    known = targets.where(F.col("target").isNotNull() & (F.col("target") != 0))
    rows = as_of_series(known, scores, "symbol", "trade_date", "signal_date", score_columns)
    listed = universe.select("symbol", "sector", (F.col("market_cap") / 1e9).alias("market_cap_b"))
    filled = of_symbols(rows, listed).fillna(0.0, [*score_columns, "market_cap_b"])
    return filled.withColumns(one_hot("sector", SECTORS, "sector"))


def indicator_names() -> list[str]:
    return [*one_hot("sector", SECTORS, "sector")]


def feature_names(score_columns: list[str]) -> list[str]:
    return [*score_columns, "market_cap_b", *indicator_names()]


def split_by_date(features: DataFrame, shares: tuple[float, float] = (0.64, 0.80)) -> dict[str, DataFrame]:
    """Train, validation and test parts cut at dates, so that no later day trains a model.

    The cuts are quantiles of the trading days, of which there is one row per date. They are worked out once, not by each reader of a
    part, and stand in the filters as days, which Parquet files are read by.
    """
    days = features.select("trade_date").distinct()
    found = days.agg(*(F.percentile(F.unix_date("trade_date"), F.lit(s)) for s in shares)).first()
    cut = [F.date_from_unix_date(F.lit(None if c is None else floor(c)).cast("int")) for c in found]
    at = F.col("trade_date")
    return {
        "train": features.where(at <= cut[0]), "validation": features.where((at > cut[0]) & (at <= cut[1])),
        "test": features.where(at > cut[1]),
    }


def train_return_model(train: DataFrame, inputs: list[str], validation: DataFrame | None = None, trees: int = 60, depth: int = 6, rate: float = 0.05,
                       indicators: Sequence[str] = ()) -> PipelineModel:
    """Robust scaling and boosted trees, all fitted by Spark ML over the whole training part.

    With validation rows no more trees are added once these stop gaining. ``indicators`` are inputs of 0 and 1, which keep their values: Spark's
    scaler turns a column whose quartiles are equal, as of a sector with under a quarter of the rows, into zeros. Scaled rows are
    stored, one table a part, since the trees read them several times and would assemble and scale all of both parts each time.
    """
    trained = GBTRegressor(featuresCol="features", labelCol="target", predictionCol="predicted", maxIter=trees, maxDepth=depth,
                           stepSize=rate, subsamplingRate=0.8, minInstancesPerNode=5, seed=42)
    scaled = Pipeline(stages=[
        VectorAssembler(inputCols=[n for n in inputs if n not in indicators], outputCol="raw"),
        RobustScaler(inputCol="raw", outputCol="scaled", withCentering=True),
        VectorAssembler(inputCols=["scaled", *indicators], outputCol="features"),
    ]).fit(train)
    rows = _scaled(scaled, train)
    if validation is not None:
        trained.setValidationIndicatorCol("held_back")
        rows = rows.withColumn("held_back", F.lit(False)).unionByName(_scaled(scaled, validation).withColumn("held_back", F.lit(True)))
    return PipelineModel([*scaled.stages, trained.fit(rows)])


def _scaled(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return stored(model.transform(rows).select("features", "target"), "scaled-rows")


def importances(model: PipelineModel, inputs: list[str]) -> DataFrame:
    """Share of the trees' gain by input."""
    first, _, last, trees = model.stages
    placed = [*first.getInputCols(), *last.getInputCols()[1:]]
    gain = dict(zip(placed, trees.featureImportances.toArray()))
    spark = SparkSession.active()
    return spark.createDataFrame([(name, float(gain[name])) for name in inputs], "feature string, importance double")


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).drop("raw", "scaled", "features")


def validation_error(model: PipelineModel, validation: DataFrame) -> float:
    return RegressionEvaluator(labelCol="target", predictionCol="predicted", metricName="rmse").evaluate(predict(model, validation))


def evaluate_predictions(scored: DataFrame, target: str = "target", predicted: str = "predicted") -> DataFrame:
    """Error figures in one row; the error quantiles come from a distributed sort."""
    y, p = F.col(target), F.col(predicted)
    known = scored.where(y.isNotNull() & p.isNotNull()).select(y.alias("_y"), p.alias("_p"))
    e = F.col("_p") - F.col("_y")
    facts = known.agg(
        F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (1 - ratio(F.avg(e * e), F.var_pop("_y"))).alias("r2"),
        F.avg(((F.col("_p") > 0) == (F.col("_y") > 0)).cast("int")).alias("directional_accuracy"), F.count("*").alias("samples"),
    )
    spread = exact_quantiles(known.select(F.abs(e).alias("_e")), "_e", {"median_error": 0.5, "p90_error": 0.9})
    both = spread.select(F.struct(*spread.columns)).scalar()
    return facts.withColumns({n: both[n] for n in spread.columns})


SIGNAL_BINS = [(-0.05, "STRONG_SELL"), (-0.02, "SELL"), (0.02, "HOLD"), (0.05, "BUY")]


def prediction_signals(predictions: DataFrame) -> DataFrame:
    """Newest prediction per symbol, ranked densely and labelled."""
    newest = latest_by(predictions.select("symbol", "trade_date", F.round("predicted", 6).alias("predicted")), ["symbol"], "trade_date")
    ranked = tied_rank(newest, "predicted", "symbol", "prediction_rank", "dense")
    return ranked.withColumns({
        "predicted_return_pct": F.col("predicted") * 100,
        "signal": ladder(F.col("predicted"), SIGNAL_BINS, "STRONG_BUY", by="<="),
    })


SEQUENCE_FEATURES = (
    "open", "high", "low", "close", "volume", "daily_range", "daily_return", "dollar_volume", "price_to_sma20",
    "price_to_sma50", "price_to_sma200", "relative_volume", "normalized_volatility",
)


def daily_features(bars: DataFrame) -> DataFrame:
    """Price-derived features and forward returns per bar that has a three-month outlook."""
    c = F.col
    rows = volume_ratio(rolling_volatility(moving_averages(bars)), (20,)).withColumns({
        "daily_range": ratio(c("high") - c("low"), c("open")), "daily_return": ratio(c("close") - c("open"), c("open")),
        "dollar_volume": c("volume") * c("close"), "relative_volume": c("volume_ratio"),
        **{f"price_to_sma{n}": ratio(c("close"), c(f"sma_{n}")) for n in (20, 50, 200)},
    })
    outlook = forward_changes(rows, {"return_5d": 5, "return_1m": 21, "return_3m": 63})
    return outlook.where(c("return_3m").isNotNull()).select(
        "symbol", "trade_date", *SEQUENCE_FEATURES, "return_5d", "return_1m", "return_3m")


def sequence_features(bars: DataFrame, target: str = "return_1m", length: int = 60) -> DataFrame:
    return sequences(daily_features(bars), SEQUENCE_FEATURES, target, length)


def ensemble(first: DataFrame, second: DataFrame, weight: float = 0.6) -> DataFrame:
    keys = ["symbol", "trade_date"]
    a = first.select(*keys, F.col("predicted").alias("_a"))
    b = second.select(*keys, F.col("predicted").alias("_b"))
    return a.join(b, keys).select(*keys, (F.col("_a") * weight + F.col("_b") * (1 - weight)).alias("predicted"))
