"""Supervised baselines on feature frames (pyspark.ml)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions.columns import clip
from wayfare.operators.evaluate import all_metrics, point_metrics
from wayfare.session import settle


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight per class: rows / (2 x rows of the class), and the negative:positive ratio."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    other = total - F.col("n")
    return counts.withColumn("weight", total / (2 * F.col("n"))).withColumn("other_ratio", other / F.col("n"))


def with_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Attach the balanced weight; it depends on one count per class only."""
    total = df.select(F.count(F.lit(1))).scalar()
    positive = df.select(F.count_if(F.col(label) == 1)).scalar()
    size = F.when(F.col(label) == 1, positive).otherwise(total - positive)
    return df.withColumn("weight", total / (2 * size))


def _vector(columns: Sequence[str], output: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol=output, handleInvalid="keep")


def random_forest(columns: Sequence[str], *, trees: int = 100, depth: int = 5, leaf: int = 1, rows: float = 1.0, features: str = "auto", seed: int = 42) -> Pipeline:
    """``leaf``: least rows of a leaf; ``rows``: share of rows a tree draws; ``features``: how many columns a split looks at."""
    model = RandomForestClassifier(
        labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, subsamplingRate=rows, featureSubsetStrategy=features, seed=seed, featuresCol="features"
    )
    return Pipeline(stages=[_vector(columns), model])


def boosting(
    columns: Sequence[str], *, rounds: int = 50, depth: int = 4, rate: float = 0.1, leaf: int = 1, rows: float = 1.0, features: str = "all",
    held: str | None = None, tolerance: float = 0.001, seed: int = 42,
) -> Pipeline:
    """As ``random_forest``; rows that ``held`` marks take no part in the fit and end it as soon as a round gains too little on them."""
    model = GBTClassifier(
        labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=rate, minInstancesPerNode=leaf, subsamplingRate=rows, featureSubsetStrategy=features,
        validationTol=tolerance, seed=seed,
    )
    return Pipeline(stages=[_vector(columns), model.setValidationIndicatorCol(held) if held else model])


def rounds_by_fold(folded: DataFrame, columns: Sequence[str], *, folds: int, most: int = 200, **options) -> DataFrame:
    """fold, rounds, log_loss, brier_score: boosting on the other folds until the held-out fold gains no more, and its scores there.

    Class weights come from the training folds alone.  One row per fold; a fold without rows has none.
    """
    rows = settle(folded)
    found, scored = [], None
    for fold in range(folds):
        here = F.col("fold") == fold
        if rows.where(here).isEmpty():
            continue
        weights = class_weights(rows.where(~here)).select("label", "weight")
        model = boosting(columns, rounds=most, held="_held", **options).fit(rows.withColumn("_held", here).join(F.broadcast(weights), "label"))
        found.append((fold, model.stages[-1].getNumTrees))
        part = probability(model, rows.where(here)).select("fold", "label", "p")
        scored = part if scored is None else scored.unionByName(part)
    taken = folded.sparkSession.createDataFrame(found, "fold int, rounds int")
    return taken.withColumns({"log_loss": F.lit(None).cast("double"), "brier_score": F.lit(None).cast("double")}) if scored is None else taken.join(
        point_metrics(scored, "fold").select("fold", "log_loss", "brier_score"), "fold"
    )


def stopped_boosting(folded: DataFrame, columns: Sequence[str], *, folds: int, most: int = 200, **options) -> tuple[PipelineModel, DataFrame]:
    """Boosting on all rows with the middle number of rounds that the folds stopped at, and the table of the folds."""
    taken = settle(rounds_by_fold(folded, columns, folds=folds, most=most, **options))
    rounds = taken.select(F.ceil(F.median("rounds")).cast("int")).first()[0]
    kept = {k: v for k, v in options.items() if k != "tolerance"}
    return boosting(columns, rounds=rounds, **kept).fit(with_weights(folded)), taken


def logistic(columns: Sequence[str], *, max_iter: int = 100, ridge: float = 0.01) -> Pipeline:
    model = LogisticRegression(labelCol="label", weightCol="weight", maxIter=max_iter, regParam=ridge)
    return Pipeline(stages=[_vector(columns, "_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True), model])


MAKERS: Mapping[str, Callable[..., Pipeline]] = {
    "random_forest": random_forest,
    "boosting": boosting,
    "logistic": logistic,
}


def probability(model: PipelineModel, df: DataFrame, name: str = "p") -> DataFrame:
    """Attach P(label = 1)."""
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.select(*df.columns, name)


def importances(model: PipelineModel, columns: Sequence[str], df: DataFrame) -> DataFrame:
    """Features by importance."""
    values = [float(v) for v in model.stages[-1].featureImportances.toArray()]
    return df.sparkSession.createDataFrame(list(zip(columns, values, strict=True)), "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def holdout_accuracy(scored: DataFrame, *, p: str = "p", label: str = "label") -> DataFrame:
    hit = (F.col(p) >= 0.5).cast("int") == F.col(label)
    return scored.agg(F.avg(hit.cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def compare_models(
    split: DataFrame, columns: Sequence[str], makers: Mapping[str, Pipeline]
) -> DataFrame:
    """Fit every pipeline on the training rows (is_test false) and compare on the rest."""
    rows = settle(split)
    train = with_weights(rows.where(~F.col("is_test")))
    test = rows.where("is_test")
    scored: DataFrame | None = None
    for name, pipeline in makers.items():
        part = probability(pipeline.fit(train), test).select(F.lit(name).alias("model"), "id", "label", "p")
        scored = part if scored is None else scored.unionByName(part)
    return all_metrics(scored).orderBy(F.desc("roc_auc"), "model")


def tune(
    folded: DataFrame, columns: Sequence[str], maker: str, grid: Mapping[str, Sequence], *, folds: int
) -> DataFrame:
    """Mean fold log loss and Brier score of every parameter set (fold column from the stratified split)."""
    rows = settle(folded)
    spark = rows.sparkSession
    names = list(grid)
    trials = []
    for number, values in enumerate(product(*grid.values())):
        params = dict(zip(names, values, strict=True))
        scored: DataFrame | None = None
        for fold in range(folds):
            model = MAKERS[maker](columns, **params).fit(with_weights(rows.where(F.col("fold") != fold)))
            part = probability(model, rows.where(F.col("fold") == fold)).select("fold", "label", "p")
            scored = part if scored is None else scored.unionByName(part)
        mean = point_metrics(scored, "fold").agg(
            F.avg("log_loss").alias("log_loss"), F.avg("brier_score").alias("brier_score")
        ).first()
        trials.append((number, *[float(v) for v in values], mean.log_loss, mean.brier_score))
    schema = "trial int, " + ", ".join(f"{n} double" for n in names) + ", log_loss double, brier_score double"
    return spark.createDataFrame(trials, schema)


def isotonic(train: DataFrame, test: DataFrame, *, p: str = "p", label: str = "label") -> DataFrame:
    """Monotone calibration fitted on held-out scores; outside values take the border value.

    Equal scores are pooled first, so the fit sees one weighted row per distinct score.
    """
    pooled = train.groupBy(p).agg(F.avg(label).alias("_rate"), F.count(F.lit(1)).cast("double").alias("_weight"))
    model = IsotonicRegression(
        featuresCol=p, labelCol="_rate", weightCol="_weight", predictionCol="calibrated"
    ).fit(pooled)
    return model.transform(test).withColumn("calibrated", clip(F.col("calibrated")))


def log_speed_model(train: DataFrame, columns: Sequence[str], *, rounds: int = 30, depth: int = 4, seed: int = 42) -> PipelineModel:
    """Regressor for the log speed of a journey."""
    model = GBTRegressor(
        labelCol="log_alpha", featuresCol="features", maxIter=rounds, maxDepth=depth, seed=seed, predictionCol="predicted_log_alpha"
    )
    return Pipeline(stages=[_vector(columns), model]).fit(train)
