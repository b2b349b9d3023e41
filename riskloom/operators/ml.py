"""Risk model: scaling, scoring, evaluation and sequential training."""

from __future__ import annotations

import json

from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .process import FEATURES


@dataclass
class Model:
    weights: list[float]
    bias: float
    means: list[float]
    stds: list[float]
    feature_names: list[str] = field(default_factory=lambda: list(FEATURES))


#: The published demonstration model and its presets (fixed values).
DEMO = Model(
    weights=[0.21, 0.15, 0.08, 0.06, 0.12, 0.32, 0.10, 0.14, -0.05, 0.18, 0.25, 0.30, -0.20, 0.11], bias=-1.5,
    means=[10, 3, 500, 200, 700, 2.5, 2, 3, 365, 180, 15, 5, 0.6, 2], stds=[15, 4, 800, 400, 1200, 2.0, 2, 2, 400, 250, 25, 10, 0.3, 3],
)
PRESETS = {
    "stable": [2, 1, 50, 10, 60, 0.5, 1, 1.2, 500, 250, 2, 0, 0.9, 0], "risky": [25, 8, 1500, 600, 2100, 4.5, 4, 5.5, 100, 400, 40, 15, 0.3, 8],
    "churn": [40, 12, 2500, 1200, 3700, 5.8, 6, 7.0, 50, 800, 80, 25, 0.4, 12], "new": [1, 1, 300, 100, 400, 1.0, 1, 2.0, 10, 5, 5, 1, 1.0, 0],
}


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def vector(features: dict[str, Column] | list[str]) -> Column:
    """Features in order as an array of doubles, missing ones 0."""
    cols = [features.get(n, F.lit(0.0)) for n in FEATURES] if isinstance(features, dict) else [F.col(n) for n in features]
    return F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols])


def linear(model: Model, columns: list[str], floor: float | None = None) -> Column:
    """z of the model on plain columns: an expression of arithmetic only. ``floor``: least standard deviation."""
    z = F.lit(float(model.bias))
    for w, m, s, c in zip(model.weights, model.means, model.stds, columns):
        z = z + F.lit(float(w)) * (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - float(m)) / float(max(s, floor) if floor else s)
    return z


def predict(df: DataFrame, model: Model, columns: list[str] = FEATURES, floor: float | None = None) -> DataFrame:
    """df with ``p`` and ``risky`` (p at least one half)."""
    p = sigmoid(linear(model, columns, floor))
    return df.withColumn("p", p).withColumn("risky", F.col("p") >= 0.5)


def scaling(df: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """Mean and population standard deviation of each feature; a variance of at most 1e-12 gives 1."""
    wide = df.agg(*[F.struct(F.avg(c).alias("mean"), F.var_pop(F.col(c).cast("double")).alias("v")).alias(c) for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}.mean").alias("mean"), F.when(F.col(f"{c}.v") <= 1e-12, 1.0).otherwise(F.sqrt(f"{c}.v")).alias("std")) for c in columns]))
    return wide.select(rows.alias("r")).select("r.*")


def confusion(df: DataFrame, by: list[str] = (), p: str = "p", label: str = "label") -> DataFrame:
    """Confusion counts at one half and accuracy, precision, recall, F1; 0 where a ratio is undefined."""
    hit, real = F.col(p) >= 0.5, F.col(label)
    out = df.groupBy(*by).agg(F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & ~real).alias("tn"), F.count_if(~hit & real).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    out = out.withColumns({"accuracy": ratio(tp + tn, tp + fp + tn + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def auc(df: DataFrame, by: list[str], p: str = "p", label: str = "label", digits: int = 6) -> DataFrame:
    """Area under the ROC curve per group, trapezoids over distinct scores; one half if a class is absent.

    Scores are rounded first, which makes ties the same everywhere and bounds the window of a group: it holds one row
    per distinct score, at most 10^digits + 1, whatever the number of rows.
    """
    per = df.groupBy(*by, F.round(p, digits).alias("s")).agg(F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg"))
    order = Window.partitionBy(*by).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    area = F.col("neg") * (F.sum("pos").over(order) - F.col("pos") / 2.0)
    out = per.withColumn("area", area).groupBy(*by).agg(F.sum("area").alias("area"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return out.select(*by, F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("area") / (F.col("pos") * F.col("neg"))).otherwise(0.5).alias("auc"))


def sgd(x: np.ndarray, y: np.ndarray, rate: float = 0.1, decay: float = 0.001, epochs: int = 500) -> tuple[np.ndarray, float]:
    """Logistic regression by stochastic gradient descent in row order from zero; L2 on weights only, rate falling per epoch."""
    w, b = np.zeros(x.shape[1]), 0.0
    for epoch in range(epochs):
        step = rate / (1.0 + 0.001 * epoch)
        for row, target in zip(x, y):
            error = 1.0 / (1.0 + np.exp(-np.clip(w @ row + b, -500, 500))) - target
            w -= step * (error * row + decay * w)
            b -= step * error
    return w, b


def train(df: DataFrame, by: str, order: list[str], columns: list[str] = FEATURES, label: str = "label", epochs: int = 500, most: int = 20_000) -> DataFrame:
    """One model per group, trained on its rows in the given order: by, weights, bias, means, stds, n.

    The descent is sequential by definition, so a group is one task. It is fitted on at most ``most`` rows, those first
    in the order of a hash of the order columns (a bounded training sample); scoring covers all rows.
    """
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.xxhash64(*order), *order))
    rows = df.withColumn("__place", place).where(F.col("__place") <= most).select(by, *order, label, *columns)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = pdf[columns].to_numpy(float)
        means, v = x.mean(0), x.var(0)
        stds = np.where(v <= 1e-12, 1.0, np.sqrt(v))
        w, b = sgd((x - means) / stds, pdf[label].to_numpy(float), epochs=epochs)
        return pd.DataFrame([(pdf[by].iloc[0], w.tolist(), float(b), means.tolist(), stds.tolist(), len(pdf))], columns=[by, "weights", "bias", "means", "stds", "n"])

    return rows.groupBy(by).applyInPandas(fit, f"{by} string, weights array<double>, bias double, means array<double>, stds array<double>, n long")


def predict_with(df: DataFrame, models: DataFrame, by: str, columns: list[str] = FEATURES) -> DataFrame:
    """df scored by the model of its group."""
    scaled = F.zip_with(F.zip_with(F.zip_with(vector(columns), "means", lambda x, m: x - m), "stds", lambda x, s: x / s), "weights", lambda x, w: x * w)
    joined = df.join(models.select(by, "weights", "bias", "means", "stds"), by)
    return joined.withColumn("p", sigmoid(F.aggregate(scaled, F.col("bias"), lambda a, x: a + x))).drop("weights", "bias", "means", "stds")


def save_model(model: Model, path: str) -> None:
    with open(path, "w") as f:
        json.dump(asdict(model), f)


def load_model(path: str) -> Model:
    with open(path) as f:
        return Model(**json.load(f))


