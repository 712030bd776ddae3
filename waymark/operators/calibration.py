"""Weights of effort learnt from observed steps: stratified alternatives, pair differences, projected gradient."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..sources.shared import stored
from .scoring import group_distance

#: Alternatives for a step by stratum, the parts of effort, and what stands for them without evidence.
TAKE = (32, 16, 15)
PARTS = ("gap", "domain", "unsupported", "transfer")
DEFAULT = {"weights": (0.35, 0.15, 0.25, 0.25), "low_max": 0.3, "moderate_max": 0.6}

#: Primes beyond any pool's size: a walk of such a stride meets every place of a pool once.
_STRIDES = (1_000_000_007, 1_000_000_009, 1_000_000_021, 1_000_000_033, 1_000_000_087, 1_000_000_093, 1_000_000_097, 1_000_000_103)
_BUCKETS = 256


def _numbered(members: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(pool, place, role) and (pool, size): each pool's members in an order of hashes, numbered from 0 in buckets, so that
    no pool is sorted in one task."""
    h = members.withColumn("h", F.xxhash64(F.lit(seed), "role")).withColumn("bucket", F.pmod("h", F.lit(_BUCKETS)))
    n = h.groupBy("pool", "bucket").agg(F.count("*").alias("n"))
    offset = n.withColumn("offset", F.sum("n").over(Window.partitionBy("pool").orderBy("bucket")) - F.col("n")).drop("n")
    inner = F.row_number().over(Window.partitionBy("pool", "bucket").orderBy("h", "role")) - 1
    placed = h.withColumn("inner", inner).join(offset, ["pool", "bucket"]).select("pool", (F.col("offset") + F.col("inner")).alias("place"), "role")
    return placed, n.groupBy("pool").agg(F.sum("n").alias("size"))


def sample_alternatives(events: DataFrame, roles: DataFrame, take: tuple[int, int, int] = TAKE, seed: int = 17, by: tuple[str, ...] = ()) -> DataFrame:
    """(event, *by, role, stratum, weight): for each step (event, src, dst) roles that could have been next, drawn without
    replacement from those of the source's group (0), the popular ones (1), and all (2).

    roles: (role, grp, popular), grp null for none. Source and target are no alternatives in strata 0 and 2; a role is
    drawn once; where a group has no other role, stratum 0 draws from all. weight is how many roles of the stratum each
    drawn one stands for: pool / taken. An event walks each pool, which lies in an order of hashes, from a place and
    with a stride of its own, so only as many rows are made as may be needed, whatever a pool's size, and
    the draw is the same on every run and partitioning. Events are dealt once, by columns of theirs (`by`, or event), before
    draws are made; those of an event are then one list, and no draw is shuffled."""
    keys = by or ("event",)
    known = stored(roles.select("role", "grp", F.coalesce("popular", F.lit(False)).alias("popular")), "roles")
    any_, popular = F.lit("any"), F.lit("popular")
    members = known.filter("grp is not null and grp <> ''").select(F.concat(F.lit("g:"), "grp").alias("pool"), "role")
    members = members.unionByName(known.filter("popular").select(popular.alias("pool"), "role")).unionByName(known.select(any_.alias("pool"), "role"))
    placed, sizes = (stored(df, "pools") for df in _numbered(members, seed))
    by_only = [c for c in by if c not in ("event", "src", "dst")]
    end = lambda name: known.select(F.col("role").alias(name), F.col("grp").alias(f"{name}_grp"), F.lit(1).alias(f"{name}_known"))
    e = events.select("event", "src", "dst", *by_only).join(end("src"), "src", "left").join(end("dst"), "dst", "left").na.fill(0, ["src_known", "dst_known"])
    own = sizes.filter("pool like 'g:%'").select(F.expr("substring(pool, 3)").alias("src_grp"), F.col("size").alias("own"))
    same = F.when((F.col("dst_grp") == F.col("src_grp")) & (F.col("dst") != F.col("src")), 1).otherwise(0)
    e = e.join(own, "src_grp", "left").withColumn("hard", F.coalesce(F.col("own"), F.lit(0)) - F.col("src_known") - same)
    e = e.repartition(*keys)
    # as many draws as can be turned down, and those that are taken
    most = (take[0] + 2, take[1] + take[0], take[2] + 2 + take[0] + take[1])
    hard = F.when(F.col("hard") > 0, F.concat(F.lit("g:"), "src_grp")).otherwise(any_)
    strata = F.array(*(F.struct(F.lit(k).alias("stratum"), pool.alias("pool"), F.lit(n).alias("most")) for k, (pool, n) in enumerate(zip((hard, popular, any_), most, strict=True))))
    own_columns = ["event", "src", "dst", *by_only]
    s = e.select(*own_columns, "hard", (F.col("src_known") + F.when(F.col("dst") != F.col("src"), F.col("dst_known")).otherwise(0)).alias("ends"), F.explode(strata).alias("x")).select(*own_columns, "hard", "ends", "x.*")
    s = s.join(sizes, "pool")
    key = lambda *salt: F.xxhash64(F.lit(seed), "event", "stratum", *map(F.lit, salt))
    stride = F.element_at(F.array(*map(F.lit, _STRIDES)), (F.pmod(key("stride"), F.lit(len(_STRIDES))) + 1).cast("int"))
    draws = s.withColumn("stride", stride % F.col("size")).withColumn("first", F.pmod(key("first"), F.col("size"))).withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.least("size", F.col("most").cast("long")) - 1)))
    d = draws.withColumn("place", (F.col("first") + F.col("draw") * F.col("stride")) % F.col("size")).join(placed, ["pool", "place"])
    d = d.join(known.select("role", "popular"), "role").filter((F.col("stratum") == 1) | ((F.col("role") != F.col("src")) & (F.col("role") != F.col("dst"))))
    elsewhere = (F.col("role") != F.col("src")) & (F.col("role") != F.col("dst"))
    drawn = F.array_sort(F.collect_list(F.struct("stratum", "draw", "role", "popular", "size", elsewhere.alias("elsewhere"))))
    one = d.groupBy(*own_columns).agg(F.first("hard").alias("hard"), F.first("ends").alias("ends"), drawn.alias("drawn"))
    names = lambda k: F.transform(f"taken_{k}", lambda y: y["role"])
    for k, n in enumerate(take):
        one = one.withColumn(f"taken_{k}", F.slice(F.filter("drawn", _free(k)), 1, n))
        one = one.withColumn(f"names_{k}", names(k))
    zero, first, rest = (F.size(f"taken_{k}") for k in range(3))
    first_popular = F.size(F.filter("taken_0", lambda y: y["popular"]))
    second_taken = F.size(F.filter("taken_1", lambda y: y["elsewhere"]))
    pools = (
        lambda y: F.when(F.col("hard") > 0, F.col("hard")).otherwise(y["size"] - F.col("ends")) / zero, lambda y: (y["size"] - first_popular) / first,
        lambda y: (y["size"] - F.col("ends") - zero - second_taken) / rest,
    )
    weighed = lambda pool: lambda y: F.struct(y["role"].alias("role"), y["stratum"].alias("stratum"), pool(y).cast("double").alias("weight"))
    out = F.concat(*(F.transform(f"taken_{k}", weighed(pool)) for k, pool in enumerate(pools)))
    return one.select(*dict.fromkeys(["event", *by]), F.explode(out).alias("x")).select(*dict.fromkeys(["event", *by]), "x.role", "x.stratum", "x.weight")


def _free(k: int):
    """Whether a draw is of stratum k and its role wasn't taken in one before."""
    return lambda y: _all([y["stratum"] == k, *(~F.array_contains(f"names_{i}", y["role"]) for i in range(k))])


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def step_features(pairs: DataFrame, owned: DataFrame, roles: DataFrame, support: DataFrame) -> DataFrame:
    """pairs (event, src, role, ...) with the four parts of effort; pairs for which one is unknown are left out.

    owned: (event, skills); roles: (role, grp, skills), skills as arrays of (skill, idf); support: (src, role, support).
    gap: the idf share of the role's skills that the event's person lacks; transfer: that the source doesn't need."""
    share = lambda a, b: F.when(_idf(b) > 0, _idf(F.array_except(b, a)) / _idf(b)).otherwise(0.0)
    empty = F.array().cast(roles.schema["skills"].dataType)
    j = pairs.join(owned.select("event", F.col("skills").alias("own")), "event").join(roles.select("role", F.col("grp").alias("g"), F.col("skills").alias("need")), "role")
    j = j.join(roles.select(F.col("role").alias("src"), F.col("grp").alias("h"), F.col("skills").alias("mine")), "src").join(support.select("src", "role", "support"), ["src", "role"], "left")
    j = j.filter(F.size("need") > 0).filter(F.size("own") > 0)
    # a source that shares nothing transfers nothing, also where the shared skills have no weight at all
    kept = F.when(F.size(F.array_intersect("need", F.coalesce("mine", empty))) == 0, 1.0).otherwise(F.when(_idf(F.col("need")) > 0, share(F.coalesce("mine", empty), F.col("need"))).otherwise(1.0))
    values = {"gap": share(F.col("own"), F.col("need")), "domain": group_distance(F.col("g"), F.col("h")), "unsupported": 1 - F.coalesce("support", F.lit(0.0)), "transfer": kept}
    return j.withColumns(values).drop("own", "need", "mine", "g", "h", "support").filter("gap is not null and domain is not null")


def _idf(skills: Column) -> Column:
    return F.aggregate(skills, F.lit(0.0), lambda a, x: a + x["idf"])


def differences(positive: DataFrame, alternatives: DataFrame) -> DataFrame:
    """(d_*, weight, n): each observed step's parts less those of each of its alternatives, with their weights; equal ones are
    one, with the sum of their weights and how many they are. alternatives may be n in one themselves."""
    p = positive.select("event", *[F.col(c).alias(f"p_{c}") for c in PARTS])
    n = F.col("n") if "n" in alternatives.columns else F.lit(1)
    return merged(alternatives.join(p, "event").select(*[(F.col(f"p_{c}") - F.col(c)).alias(f"d_{c}") for c in PARTS], "weight", n.cast("long").alias("n")))


def merged(diffs: DataFrame) -> DataFrame:
    """diffs (d_*, weight, n) with equal differences as one: the loss is a sum, so weights add up."""
    return diffs.groupBy(*[f"d_{c}" for c in PARTS]).agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"))


def descend(diffs: DataFrame, steps: int = 500, rate: float = 0.1, ridge: float = 1e-3) -> tuple[np.ndarray, int]:
    """(weights, pairs): non-negative weights, which sum to one, by projected gradient descent on the logistic loss of
    `diffs` (d_*, weight): the lower the sum of an observed step, the better. Equal weights without a pair.

    The differences stay where they are, in memory or on disk; in each step every partition sums up its part of the
    gradient, and those few numbers a partition are all that reaches the driver."""
    names = [f"d_{c}" for c in PARTS]
    k = len(names)
    total = diffs.agg((F.sum("n") if "n" in diffs.columns else F.count("*")).alias("n"), F.sum("weight").alias("w")).first()
    beta = np.full(k, 1 / k)
    if not total.n:
        return beta, 0
    held = diffs.select(*names, "weight").persist(StorageLevel.MEMORY_AND_DISK)

    def gradient(beta: np.ndarray) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(k)
            for b in batches:
                x = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in names], 1)
                p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
                out += x.T @ (b.column("weight").to_numpy(zero_copy_only=False) * p)
            yield pa.RecordBatch.from_pydict({c: [v] for c, v in zip(names, out, strict=True)})

        rows = held.mapInArrow(part, ", ".join(f"{c} double" for c in names)).collect()
        return np.sum([list(r) for r in rows], 0) / total.w

    try:
        for _ in range(steps):
            before = beta
            beta = np.maximum(0.0, beta - rate * (gradient(beta) + ridge * beta))
            beta = beta / beta.sum() if beta.sum() > 1e-12 else np.full(k, 1 / k)
            if np.array_equal(beta, before):  # and so in all further steps
                break
    finally:
        held.unpersist()
    return beta, total.n


def band_limits(scores: DataFrame) -> Column:
    """The thirds of validation scores (score), or null with fewer than three."""
    finite = F.when(~F.isnan("score") & (F.abs("score") < float("inf")), F.col("score"))
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    q = F.percentile(finite, F.array(F.lit(1.0 / 3), F.lit(2.0 / 3)))
    return F.when(F.count(finite) >= 3, F.struct(unit(q[0]).alias("low"), unit(q[1]).alias("moderate")))


def calibration(spark: SparkSession, diffs: DataFrame, validation: DataFrame, steps: int = 500) -> DataFrame:
    """(part, weight, low_max, moderate_max, pairs, origin): weights learnt from `diffs`, limits of bands from the parts of
    observed validation steps. What can't be learnt, for want of pairs or of three steps, is the default (origin)."""
    beta, pairs = descend(diffs, steps)
    if pairs == 0:
        beta = np.array(DEFAULT["weights"])
    score = sum((float(b) * F.col(c) for c, b in zip(PARTS, beta, strict=True)), F.lit(0.0))
    low, high = F.lit(DEFAULT["low_max"]), F.lit(DEFAULT["moderate_max"])
    limits = validation.select(score.alias("score")).agg(band_limits(validation).alias("x"))
    wide = F.when(F.col("x.moderate") > F.col("x.low"), F.col("x.moderate")).otherwise(F.least(F.lit(1.0), F.col("x.low") + 1e-6))
    learnt = F.col("x").isNotNull() & F.lit(pairs > 0)
    row = limits.select(F.when(learnt, F.col("x.low")).otherwise(low).alias("low_max"), F.when(learnt, wide).otherwise(high).alias("moderate_max"), F.when(learnt, "learnt").otherwise("default").alias("origin"))
    parts = F.explode(F.array(*(F.struct(F.lit(c).alias("part"), F.lit(float(round(b, 6))).alias("weight")) for c, b in zip(PARTS, beta, strict=True)))).alias("p")
    return row.select(parts, "low_max", "moderate_max", "origin").select("p.part", "p.weight", F.round("low_max", 6).alias("low_max"), F.round("moderate_max", 6).alias("moderate_max"), F.lit(pairs).cast("long").alias("pairs"), "origin")
