"""Learnt rankers: gradient-boosted trees on pair features, with negatives that hashes choose."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def training_set(positives: DataFrame, candidates: DataFrame, hard: DataFrame, ratio: int = 5) -> DataFrame:
    """(src, dst, label): all positives and `ratio` negatives for each, half of them hard ones, source by source.

    hard: (src, dst, similarity) near pairs. Choice is by similarity and by a digest of the pair, so it
    is the same on every run and partitioning; sources are numbered each for itself."""
    quota = positives.groupBy("src").agg((F.count("*") * ratio).alias("quota"))
    rank = lambda *order: F.row_number().over(Window.partitionBy("src").orderBy(*order))
    half = F.floor(F.col("quota") / 2)
    near = hard.join(positives, ["src", "dst"], "left_anti").join(quota, "src").withColumn("n", rank(F.desc("similarity"), "dst")).filter(F.col("n") <= half).select("src", "dst")
    rest = candidates.join(positives, ["src", "dst"], "left_anti").join(near, ["src", "dst"], "left_anti").join(quota, "src")
    far = rest.withColumn("n", rank(F.md5(F.concat_ws("|", "src", "dst")), "dst")).filter(F.col("n") <= F.col("quota") - half).select("src", "dst")
    return positives.select("src", "dst", F.lit(1.0).alias("label")).unionByName(near.unionByName(far).withColumn("label", F.lit(0.0)))


def fit(rows: DataFrame, features: list[str], iterations: int = 20) -> PipelineModel:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), GBTClassifier(labelCol="label", maxIter=iterations, maxDepth=4, seed=7)]).fit(rows)


def predict(model: PipelineModel, rows: DataFrame, top: int, features: list[str]) -> DataFrame:
    """(src, dst, score, rank): the `top` best of each source; ties by dst. Features that a model wants and the rows lack are raised."""
    lacks = [f for f in features if f not in rows.columns]
    if lacks or model.stages[0].getInputCols() != features:
        raise ValueError(f"the model takes {len(model.stages[0].getInputCols())} features; no columns {', '.join(lacks)}")
    scored = model.transform(rows).select("src", "dst", F.round(vector_to_array("probability")[1], 9).alias("score"))
    w = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
