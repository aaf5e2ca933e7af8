"""Boosted trees on the residual, on Spark MLlib."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pingloom.operators.splits import fold
from pingloom.plans.stages import materialize


def with_missing_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Doubles plus a 0/1 column per input: the trees see imputed medians and that they were imputed."""
    return df.select(
        *[c for c in df.columns if c not in columns], *[F.col(c).cast("double").alias(c) for c in columns],
        *[F.col(c).isNull().cast("double").alias(f"{c}_missing") for c in columns])


ROWS_A_PART = 500_000  # of the table the trees are grown on: boosting keeps it and reads it once a level of each tree


def fit_gbt(train: DataFrame, columns: Sequence[str], target: str, validation: str | None = None, trees: int = 20, depth: int = 5, seed: int = 42) -> PipelineModel:
    """Pipeline of median imputation, assembly and boosting; ``validation`` names a boolean column for early stopping.

    What is assembled is dealt into parts of bounded size first, unless it is no more than one of these: files are cut by their compressed
    bytes, and a part of ten million rows in them takes more than a gigabyte as the trees' points.
    """
    imputer = Imputer(inputCols=list(columns), outputCols=[f"{c}_filled" for c in columns], strategy="median")
    assembler = VectorAssembler(
        inputCols=[*[f"{c}_filled" for c in columns], *[f"{c}_missing" for c in columns]], outputCol="features", handleInvalid="keep")
    booster = GBTRegressor(featuresCol="features", labelCol=target, predictionCol="pred_residual", maxIter=trees, maxDepth=depth, seed=seed)
    if validation:
        booster = booster.setParams(validationIndicatorCol=validation)
    flagged = with_missing_flags(train, columns)
    before = Pipeline(stages=[imputer, assembler]).fit(flagged)
    rows = before.transform(flagged).select("features", target, *([validation] if validation else []))
    n = train.count()
    if n > ROWS_A_PART:
        rows = rows.repartition(max(train.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS_A_PART)))
    return PipelineModel([*before.stages, booster.fit(rows)])


def score(df: DataFrame, model: PipelineModel, columns: Sequence[str], baseline: str = "baseline") -> DataFrame:
    """Predicted residual and the ETA rebuilt from it; the input columns come back unchanged."""
    scored = model.transform(with_missing_flags(df, columns))
    return scored.select(*df.columns, "pred_residual", (F.col(baseline) + F.col("pred_residual")).alias("predicted"))


def temporal_cv(parts: DataFrame, columns: Sequence[str], target: str, n_folds: int = 4, trees: int = 5, depth: int = 3) -> DataFrame:
    """Validation error per expanding-window fold. ``parts`` comes from ``ts_cv_folds``; it is written once, by part, for all fits."""
    parts = materialize(parts, partition_by=["part"])
    out = None
    for k in range(1, n_folds + 1):
        train, held = fold(parts, k, target)
        model = fit_gbt(train, columns, target, trees=trees, depth=depth)
        scored = model.transform(with_missing_flags(held, columns))
        row = scored.agg(F.lit(k).alias("fold"), F.avg(F.abs(F.col(target) - F.col("pred_residual"))).alias("mae"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean and population deviation of the folds' errors, the best and the worst, and the rows validated."""
    return folds.agg(F.count("*").alias("n_folds"), F.avg("mae").alias("mean_mae"), F.stddev_pop("mae").alias("std_mae"), F.min("mae").alias("best_mae"), F.max("mae").alias("worst_mae"), F.sum("n").alias("n"))


def score_vehicle_stops(positions: DataFrame, stop_seq: DataFrame, model: PipelineModel, columns: Sequence[str], inputs: dict[str, Column], baseline: Column) -> DataFrame:
    """The latest positions x all stops of their routes, each with its predicted ETA: what a stop's board shows for every vehicle.

    ``positions`` has a row a vehicle, ``stop_seq`` a row a (route, stop); a route's stops bound what a vehicle becomes. ``inputs`` and
    ``baseline`` are expressions over both sides' columns (``stop_`` before those of the stop).
    """
    stops = stop_seq.select("route_id", *[F.col(c).alias(c if c.startswith("stop_") else f"stop_{c}") for c in stop_seq.columns if c != "route_id"])
    pairs = positions.join(stops, "route_id")
    kept = ["vehicle_id", "route_id", "stop_id"]
    return score(pairs.select(*kept, *[e.cast("double").alias(n) for n, e in inputs.items()], baseline.cast("double").alias("baseline")), model, columns)


def feature_importance(spark, model: PipelineModel, columns: Sequence[str]) -> DataFrame:
    """Split-gain importance per input (the missing flag's share counts towards its column)."""
    weights = model.stages[-1].featureImportances.toArray()
    n = len(columns)
    rows = [(c, float(weights[i] + weights[n + i])) for i, c in enumerate(columns)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
