"""Boosted trees on pairwise lambda gradients, choice of a configuration, fusion with a baseline and a gate."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.storagelevel import StorageLevel

from .evaluation import metrics_by as metrics_by

#: The gain of each grade.
GAINS = (0.0, 1.0, 3.0, 7.0)


@dataclass(frozen=True)
class Boosting:
    depth: int = 4
    rounds: int = 10
    rate: float = 0.3
    #: added to the weights of a leaf
    ridge: float = 1e-3


#: Configurations that are tried.
CONFIGS = (Boosting(3, 8), Boosting(4, 8), Boosting(5, 12, 0.2))


def lambdas(grades: np.ndarray, scores: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient, weight) of one list's rows: for every two rows of different grades the loss of NDCG if they changed places,
    times how wrongly their scores lie; equal scores go in order of `tie`."""
    order = np.lexsort((tie, -scores))
    place = np.empty(len(scores), np.int64)
    place[order] = np.arange(len(scores))
    gain = np.asarray(GAINS)[grades]
    ideal = (np.sort(gain)[::-1] / np.log2(np.arange(len(gain)) + 2)).sum()
    if ideal == 0:
        return np.zeros(len(scores)), np.zeros(len(scores))
    disc = 1 / np.log2(place + 2)
    better = gain[:, None] > gain[None, :]
    delta = np.where(better, np.abs(gain[:, None] - gain[None, :]) * np.abs(disc[:, None] - disc[None, :]) / ideal, 0.0)
    rho = 1 / (1 + np.exp(np.clip(scores[:, None] - scores[None, :], -40, 40)))
    up, bend = delta * rho, delta * rho * (1 - rho)
    return up.sum(1) - up.sum(0), bend.sum(1) + bend.sum(0)


def _gradients(rows: DataFrame) -> DataFrame:
    """rows (src, dst, features, grade, score) with lambda and weight, list by list; a list is a source's candidates, whose
    number the channels bound."""
    schema = StructType([*rows.schema.fields, StructField("lambda", DoubleType()), StructField("weight", DoubleType())])
    arrow = to_arrow_schema(schema)

    def one(table: pa.Table) -> pa.Table:
        names = np.array(table["dst"].to_pylist(), dtype=object)
        g, w = lambdas(table["grade"].to_numpy().astype(int), table["score"].to_numpy(), np.argsort(np.argsort(names, kind="stable"), kind="stable"))
        return table.append_column("lambda", pa.array(g)).append_column("weight", pa.array(w)).cast(arrow)

    return rows.groupBy("src").applyInArrow(one, schema)


def _added(rows: DataFrame, trees: list[DecisionTreeRegressionModel], rate: float) -> DataFrame:
    """rows (..., features) with score: the sum of the trees."""
    out = rows.withColumn("vector", array_to_vector("features"))
    score = F.lit(0.0)
    for k, tree in enumerate(trees):
        out = tree.copy().setFeaturesCol("vector").setPredictionCol(f"_t{k}").transform(out)
        score = score + rate * F.col(f"_t{k}")
    return out.withColumn("score", score).drop("vector", *(f"_t{k}" for k in range(len(trees))))


def packed(rows: DataFrame, features: list[str]) -> DataFrame:
    """rows with their features as one array; features that they lack are raised."""
    lacks = [f for f in features if f not in rows.columns]
    if lacks:
        raise ValueError(f"no columns {', '.join(lacks)}")
    return rows.withColumn("features", F.array(*[F.col(f).cast("double") for f in features])).drop(*features)


def fit(rows: DataFrame, config: Boosting) -> list[DecisionTreeRegressionModel]:
    """Trees learnt from graded rows (src, dst, features, grade), one a round on the lambdas under the trees before it.

    A leaf is the sum of its lambdas over that of their weights. The rows lie by source, in memory or on disk, so that
    no round shuffles them. Lists whose rows all have one grade, be it none or the highest, teach nothing, for no two of
    them could change places; without any other list the ranker is empty."""
    some = rows.groupBy("src").agg(F.min("grade").alias("least"), F.max("grade").alias("most")).filter("least < most").select("src")
    held = rows.select("src", "dst", "features", F.col("grade").cast("int").alias("grade")).join(some, "src").repartition("src").persist(StorageLevel.MEMORY_AND_DISK)
    trees: list[DecisionTreeRegressionModel] = []
    try:
        if held.isEmpty():
            return trees
        for k in range(config.rounds):
            g = _gradients(_added(held, trees, config.rate).select("src", "dst", "features", "grade", "score")).filter("weight > 0")
            learn = g.select(array_to_vector("features").alias("vector"), (F.col("weight") + config.ridge).alias("w"), (F.col("lambda") / (F.col("weight") + config.ridge)).alias("y"))
            trees.append(DecisionTreeRegressor(featuresCol="vector", labelCol="y", weightCol="w", maxDepth=config.depth, seed=7 + k).fit(learn))
    finally:
        held.unpersist()
    return trees


def ranked(rows: DataFrame, trees: list[DecisionTreeRegressionModel], rate: float) -> DataFrame:
    """(src, dst, score, rank) of all rows (src, dst, features); ties to the smaller dst."""
    w = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    return _added(rows.select("src", "dst", "features"), trees, rate).select("src", "dst", F.round("score", 9).alias("score")).withColumn("rank", F.row_number().over(w))


def scored_grid(learn: DataFrame, rows: DataFrame, configs: tuple[Boosting, ...] = CONFIGS) -> DataFrame:
    """(config, src, dst, score, rank): rows ranked under every configuration, learnt from `learn`."""
    out = None
    for k, config in enumerate(configs):
        r = ranked(rows, fit(learn, config), config.rate).withColumn("config", F.lit(k))
        out = r if out is None else out.unionByName(r)
    return out


def best(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """(keys) of the row with the best mrr, then hits at 5 and 10; the first of equals. One row a configuration."""
    first = F.max(F.struct("mrr", "hits_5", "hits_10", *[(-F.col(k)).alias(k) for k in keys])).alias("m")
    return metrics.agg(first).filter("m is not null").select(*[(-F.col(f"m.{k}")).alias(k) for k in keys])


#: Sizes of the head that is kept, and numbers of new ones behind it.
HEADS, SLOTS = (1, 3, 5, 7, 10), (1, 3, 5, 10, 20)


def fusion_grid(primary: DataFrame, secondary: DataFrame, heads: tuple[int, ...] = HEADS, slots: tuple[int, ...] = SLOTS) -> DataFrame:
    """(head, slots, src, dst, rank) for every head and number of slots: the first ranking's head, up to `slots` rows of
    the second that the first lacks, the rest of the first, the rest of the second."""
    spark = primary.sparkSession
    grid = F.broadcast(spark.createDataFrame([(h, n) for h in heads for n in slots], "head int, slots int"))
    fresh = secondary.join(primary.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy("rank", "dst")))
    one = primary.select("src", "dst", "rank", F.lit(None).cast("int").alias("n"))
    rows = one.unionByName(fresh.select("src", "dst", "rank", "n")).join(grid, F.lit(True))
    tier = F.when(F.col("n").isNull(), F.when(F.col("rank") <= F.col("head"), 0).otherwise(2)).otherwise(F.when(F.col("n") <= F.col("slots"), 1).otherwise(3))
    w = Window.partitionBy("head", "slots", "src").orderBy("tier", "rank", "dst")
    return rows.withColumn("tier", tier).withColumn("rank", F.row_number().over(w)).select("head", "slots", "src", "dst", "rank")


def gate(metrics: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """(accepted, reasons) of metrics (split, stage, ...) with split validation or test and stage before or after."""
    names = ("mrr", "hits_5", "hits_10", "macro_mrr", "source_role_coverage", "destination_coverage")
    of = lambda split, stage, c: F.max(F.when((F.col("split") == split) & (F.col("stage") == stage), F.col(c)))
    row = metrics.agg(*[of(split, stage, c).alias(f"{split}_{stage}_{c}") for split in ("validation", "test") for stage in ("before", "after") for c in names])
    v = lambda split, c: (F.col(f"{split}_before_{c}"), F.col(f"{split}_after_{c}"))

    def fails(test: Column, why: str) -> Column:
        return F.when(F.coalesce(test, F.lit(True)), F.lit(why))

    checks = [fails(a <= b, f"{split} mrr does not improve") for split in ("validation", "test") for b, a in [v(split, "mrr")]]
    (b5, a5), (b10, a10) = v("test", "hits_5"), v("test", "hits_10")
    checks.append(fails((a5 <= b5) & (a10 <= b10), "no test hits improve"))
    checks += [fails(b - a > tolerance, f"{c} falls beyond the tolerance") for c in ("hits_5", "hits_10") for b, a in [v("test", c)]]
    checks += [fails(a + 1e-12 < b, f"{c} falls") for c in ("source_role_coverage", "destination_coverage", "macro_mrr") for b, a in [v("test", c)]]
    reasons = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return row.select((F.size(reasons) == 0).alias("accepted"), F.array_join(reasons, "; ").alias("reasons"), *[F.col(f"test_{stage}_{c}") for stage in ("before", "after") for c in ("mrr", "hits_5", "hits_10")])
