"""The four boosted models: settings, class weights, predictions, importance, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .boosting import Booster, Settings

DAY_RETURN = Settings(300, 0.05, 5, 0.8, 0.8, 3, 0.1, 1.0)
DIRECTION = Settings(400, 0.03, 4, 0.8, 0.8, 3, 0.1, 1.0)
HIGH_VOLATILITY = Settings(350, 0.04, 4, 0.85, 0.85, 3, 0.1, 1.0, weighted=True)
DROP = Settings(500, 0.03, 4, 0.8, 0.8, weighted=True)


def positive_weight(train: DataFrame, label: str) -> float:
    """Negatives for each positive; without positives an error."""
    row = train.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    if not row["p"]:
        raise ValueError(f"no positive rows of {label}")
    return row["n"] / row["p"]


def fit_classifier(train: DataFrame, features: list[str], label: str, settings: Settings) -> Booster:
    return boosting.fit(train, features, label, settings, "logistic", positive_weight(train, label) if settings.weighted else 1.0)


def fit_regressor(train: DataFrame, features: list[str], label: str, settings: Settings = DAY_RETURN) -> Booster:
    return boosting.fit(train, features, label, settings, "squared")


def predict_classes(model: Booster, df: DataFrame, negative: str = "pred_proba_0", positive: str = "pred_proba_1") -> DataFrame:
    """Both probabilities, and the label at one half."""
    p = 1 / (1 + F.exp(-F.col("_margin")))
    out = boosting.with_margin(model, df, "_margin").withColumn(positive, p).withColumn(negative, 1 - F.col(positive))
    return out.select(*df.columns, negative, positive, (F.col(positive) >= 0.5).cast("int").alias("pred_label"))


def predict_values(model: Booster, df: DataFrame) -> DataFrame:
    return boosting.with_margin(model, df, "y_pred")


def exceedance(df: DataFrame, column: str = "y_pred", bounds: tuple[float, ...] = (0.005, -0.005)) -> DataFrame:
    """Shares of predictions above positive bounds and below negative ones."""
    over = [F.avg(((F.col(column) > b) if b > 0 else (F.col(column) < b)).cast("int")).alias(f"share_{i}") for i, b in enumerate(bounds)]
    return df.agg(*over)


def importance(spark: SparkSession, model: Booster, most: int | None = None) -> DataFrame:
    """(feature, importance), the largest first."""
    out = spark.createDataFrame(list(model.importance().items()), "feature string, importance double").orderBy(F.desc("importance"), "feature")
    return out.limit(most) if most else out


def save(spark: SparkSession, model: Booster, path: str) -> None:
    """The model as one JSON document."""
    spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> Booster:
    return Booster.from_json(spark.read.text(path, wholetext=True).first()[0])
