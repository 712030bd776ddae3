"""Role vectors: cleaning, exact neighbours and threshold joins over cells of like vectors, block by block."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

#: Vectors of one side in a unit, about.
BLOCK = 2048


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalised(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """(id, vec array<double>) of unit length; null, empty, non-finite, zero and wrongly sized vectors go."""
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = vectors.filter(F.col("vec").isNotNull() & (F.size("vec") > 0) & ~F.coalesce(bad, F.lit(True)))
    if dim is not None:
        ok = ok.filter(F.size("vec") == dim)
    ok = ok.withColumn("n", norm(F.col("vec"))).filter("n > 0")
    return ok.select("id", F.transform("vec", lambda x: x.cast("double") / F.col("n")).alias("vec"))


def load_report(ids: DataFrame, vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """One row: how many of `ids` have a usable vector, none, or a rejected one."""
    good = normalised(vectors, dim).select("id", F.lit(True).alias("good"))
    have = vectors.select("id", F.lit(True).alias("have")).distinct()
    each = ids.select("id").distinct().join(have, "id", "left").join(good, "id", "left")
    return each.agg(F.count("*").alias("requested"), F.count_if("good").alias("loaded"), F.count_if(F.col("have").isNull()).alias("missing"), F.count_if(F.col("have").isNotNull() & F.col("good").isNull()).alias("rejected"))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


#: Most vectors that points are gathered around, and points for each: with fewer points there are fewer cells, or one.
CENTRES, CELL_ROWS = 256, 1024
#: Above what rounding does to bounds and to similarities, which have nine decimals.
_SLACK = 1e-8


@dataclass(frozen=True)
class Cells:
    """Points by the centre most similar to them: centres, and of each cell its number of points and the greatest angle
    between its centre and one of them. A bounded index: it holds no points."""

    centres: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Of every vector and cell: a similarity that none of the cell's points exceeds. Angles obey the triangle inequality, so
        a point lies no nearer than its centre does, less the radius."""
        angle = np.arccos(np.clip(q @ self.centres.T, -1, 1)) - self.radii
        return np.where(self.sizes > 0, np.cos(np.maximum(angle, 0)), -np.inf)

    def first(self, q: np.ndarray, k: int) -> np.ndarray:
        """Which cells come first for every vector: those of the most similar centres, until they hold k points."""
        order = np.argsort(-(q @ self.centres.T), axis=1, kind="stable")
        held = np.cumsum(self.sizes[order], axis=1)
        need = np.concatenate((np.ones((len(q), 1), bool), held[:, :-1] < k), axis=1)
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, need, axis=1)
        return out & (self.sizes > 0)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float)


def _assigned(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """points with cell and angle, the angle to its centre."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                sims = _matrix(b["vec"]) @ centres.T
                cell = sims.argmax(1)
                yield b.assign(cell=cell.astype("int32"), angle=np.arccos(np.clip(sims[np.arange(len(b)), cell], -1, 1)))

    return points.mapInPandas(run, StructType([*points.schema.fields, StructField("cell", IntegerType()), StructField("angle", DoubleType())]))


def cells(points: DataFrame, most: int = CENTRES) -> Cells | None:
    """The index of points (id, vec), unit vectors; None without any. Centres are the `most` points of least hashes, a bounded
    sample; every point is assigned. Only centres, sizes and radii reach the driver."""
    n = points.count()
    if not n:
        return None
    rows = points.select("vec").orderBy(F.xxhash64("id"), "id").limit(min(most, -(-n // CELL_ROWS))).collect()
    centres = np.array([r.vec for r in rows], float)
    if len(centres) == 1:  # one cell holds all, and no bound rules it out
        return Cells(centres, np.array([n]), np.array([np.pi]))
    sizes, radii = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in _assigned(points.select("id", "vec"), centres).groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect():
        sizes[r.cell], radii[r.cell] = r.n, r.radius
    return Cells(centres, sizes, radii)


def _visits(queries: DataFrame, index: Cells, choose: Callable[[np.ndarray, pd.DataFrame], np.ndarray]) -> DataFrame:
    """queries with cell, a row for every cell that `choose` (vectors, rows) marks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                row, cell = np.nonzero(choose(_matrix(b["vec"]), b))
                yield b.iloc[row].assign(cell=cell.astype("int32"))

    return queries.mapInPandas(run, StructType([*queries.schema.fields, StructField("cell", IntegerType())]))


def _met(visits: DataFrame, points: DataFrame, index: Cells, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """run(queries, points) over blocks of a cell's points and of the queries that visit it.

    Both are cut into blocks of about BLOCK rows by a hash of their ids, so a task holds two blocks however many
    points a cell has, and what is shuffled follows the cells that are visited. Cells are a bounded number."""
    spark = visits.sparkSession
    blocks = spark.createDataFrame([(i, max(1, -(-int(n) // BLOCK))) for i, n in enumerate(index.sizes)], "cell int, n_pb int")
    visited = visits.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_qb"))
    cut = F.broadcast(blocks.join(visited, "cell"))
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = visits.join(cut, "cell").withColumn("qb", block("n_qb")).withColumn("pb", every("n_pb")).drop("n_qb", "n_pb")
    p = _assigned(points, index.centres).drop("angle").join(cut, "cell").withColumn("pb", block("n_pb")).withColumn("qb", every("n_qb")).drop("n_qb", "n_pb")
    # columns of their own, for sides that come from one frame
    q = q.toDF(*(f"q_{c}" for c in q.columns))

    def renamed(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return run(a.rename(columns=lambda c: c[2:]), b)

    return q.groupBy("q_cell", "q_qb", "q_pb").cogroup(p.groupBy("cell", "qb", "pb")).applyInPandas(renamed, schema)


def _similarities(q: pd.DataFrame, p: pd.DataFrame) -> np.ndarray:
    return np.round(np.stack(q["vec"].to_numpy()) @ np.stack(p["vec"].to_numpy()).T, 9)


def _frame(ids, nbrs, sims) -> pd.DataFrame:
    """Columns of plain types, of any length."""
    return pd.DataFrame({"id": pd.Series(list(ids), dtype=object), "nbr": pd.Series(list(nbrs), dtype=object), "similarity": pd.Series(list(sims), dtype=float)})


PAIRS = "id string, nbr string, similarity double"


def _none(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def nearest(queries: DataFrame, points: DataFrame, k: int, index: Cells | None = None) -> DataFrame:
    """(id, nbr, similarity, rank): each query's k most similar points but itself; ties by id. Exact.

    A query first visits the cells of the centres most similar to it, until they hold k points and one; its k-th best
    there bounds what can still enter, and it visits no other cell than those whose bound reaches that."""
    queries, points = queries.select("id", "vec"), points.select("id", "vec")
    index = index or cells(points)
    if index is None:
        return _none(queries.sparkSession, PAIRS).withColumn("rank", F.lit(1))

    def run(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(q) and len(p):
            sims, names = _similarities(q, p), p["id"].to_numpy()
            for i, one in enumerate(q["id"]):
                order = np.lexsort((names, -sims[i]))
                order = order[names[order] != one][:k]
                found += zip([one] * len(order), names[order], sims[i, order], strict=True)
        return _frame(*zip(*found, strict=True)) if found else _frame((), (), ())

    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "nbr")
    best = lambda df: df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    one = best(_met(_visits(queries, index, lambda q, _: index.first(q, k + 1)), points, index, run, PAIRS)).drop("rank")
    if len(index.centres) == 1:
        return best(one)
    least = one.groupBy("id").agg(F.when(F.count("*") >= k, F.min("similarity")).alias("least"))
    asked = queries.join(least, "id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
    more = _visits(asked, index, lambda q, b: ~index.first(q, k + 1) & (index.bounds(q) >= b["least"].to_numpy()[:, None] - _SLACK)).drop("least")
    return best(one.unionByName(_met(more, points, index, run, PAIRS)))


def similar_pairs(a: DataFrame, b: DataFrame, threshold: float, inclusive: bool = False) -> DataFrame:
    """(id, nbr, similarity): pairs of a and b above the threshold (at it too, if inclusive). A vector of a visits only
    cells of b that can hold one."""

    def run(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return _frame((), (), ())
        sims = _similarities(q, p)
        i, j = np.nonzero(sims >= threshold if inclusive else sims > threshold)
        return _frame(q["id"].to_numpy()[i], p["id"].to_numpy()[j], sims[i, j])

    a, b = a.select("id", "vec"), b.select("id", "vec")
    index = cells(b)
    if index is None:
        return _none(a.sparkSession, PAIRS)
    return _met(_visits(a, index, lambda q, _: index.bounds(q) >= threshold - _SLACK), b, index, run, PAIRS)


def threshold_sweep(a: DataFrame, b: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, predicted, true, precision, recall, f1, best) of predicting that two vectors have one group
    where they are at least so similar. a, b: (id, vec, group).

    A unit gives its counts for each threshold and no pairs; best marks the greatest f1, the least threshold of equals."""

    def run(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame({"threshold": pd.Series(dtype=float), "predicted": pd.Series(dtype="int64"), "true": pd.Series(dtype="int64")})
        sims = _similarities(q, p)
        same = q["group"].to_numpy()[:, None] == p["group"].to_numpy()[None, :]
        return pd.DataFrame({"threshold": thresholds, "predicted": [int((sims >= t).sum()) for t in thresholds], "true": [int((same & (sims >= t)).sum()) for t in thresholds]})

    counts, index, least = "threshold double, predicted long, true long", cells(b), min(thresholds)
    zero = a.sparkSession.createDataFrame([(float(t), 0, 0) for t in thresholds], counts)
    each = zero
    if index is not None:
        visits = _visits(a.select("id", "vec", "group"), index, lambda q, _: index.bounds(q) >= least - _SLACK)
        each = zero.unionByName(_met(visits, b.select("id", "vec", "group"), index, run, counts))
    sizes = a.groupBy("group").agg(F.count("*").alias("n")).join(b.groupBy("group").agg(F.count("*").alias("m")), "group")
    positives = sizes.agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("positives"))
    got = each.groupBy("threshold").agg(F.sum("predicted").alias("predicted"), F.sum("true").alias("true")).crossJoin(F.broadcast(positives))
    p = F.when(F.col("predicted") > 0, F.col("true") / F.col("predicted")).otherwise(0.0)
    r = F.when(F.col("positives") > 0, F.col("true") / F.col("positives")).otherwise(0.0)
    f = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    out = got.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f).drop("positives")
    # a row a threshold: the window is over their number
    return out.withColumn("best", F.row_number().over(Window.orderBy(F.desc(F.round("f1", 9)), "threshold")) == 1)
