"""Transition models over (src, dst, count, source_total, probability) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_training(relation: str = "relation", source: str = "source", split: str = "split") -> Column:
    """The one guard against leakage: observed transitions of the training split, or of none named."""
    return (F.col(relation) == "TRANSITIONS_TO") & (F.col(source) == "trajectory") & (F.col(split).isNull() | (F.col(split) == "train"))


def walk_step(walk: DataFrame, counts: DataFrame) -> DataFrame:
    """One more step of (src, dst, p): mass on dst moves on by the transition table; src takes no part."""
    nxt = counts.select(F.col("src").alias("mid"), F.col("dst").alias("to"), "probability")
    moved = walk.join(nxt, walk["dst"] == nxt["mid"]).filter("to <> src")
    return moved.groupBy("src", F.col("to").alias("dst")).agg(F.sum(F.col("p") * F.col("probability")).alias("p"))


def walks(counts: DataFrame, steps: int = 3) -> DataFrame:
    """(src, dst, step, p) for 1 to `steps` steps."""
    walk = counts.filter("src <> dst").select("src", "dst", F.col("probability").alias("p"))
    out = walk.withColumn("step", F.lit(1))
    for i in range(2, steps + 1):
        walk = walk_step(walk, counts)
        out = out.unionByName(walk.withColumn("step", F.lit(i)))
    return out


def blend(walked: DataFrame, weights: dict[int, float]) -> DataFrame:
    """(src, dst, score): sum of steps' masses by weights, which are not negative and sum to one."""
    if any(w < 0 for w in weights.values()) or abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights must be a convex combination")
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])
    return walked.filter(F.col("step").isin(*weights)).groupBy("src", "dst").agg(F.sum(F.col("p") * w[F.col("step")]).alias("score"))


def smooth(counts: DataFrame, neighbours: DataFrame, direct_weight: float = 0.75, temperature: float = 0.06, alpha: float | None = None) -> DataFrame:
    """(src, dst, score, direct, neighbour, support, evidence) from a source's own and its neighbours' transitions.

    neighbours: (id, nbr, similarity, rank), already cut to the k nearest; those without transitions are
    left out and the softmax of similarity / temperature is taken over the rest. Both kinds of
    evidence mix by direct_weight, or as (count + alpha prior) / (total + alpha) if alpha is given."""
    known = counts.select(F.col("src").alias("nbr")).distinct()
    w = Window.partitionBy("id")
    e = neighbours.join(known, "nbr", "left_semi").withColumn("e", F.exp((F.col("similarity") - F.max("similarity").over(w)) / temperature))
    weighed = e.withColumn("w", F.col("e") / F.sum("e").over(w)).select("id", "nbr", "w")
    spread = weighed.join(counts.select(F.col("src").alias("nbr"), "dst", "probability"), "nbr").filter("dst <> id")
    prior = spread.groupBy(F.col("id").alias("src"), "dst").agg(F.sum(F.col("w") * F.col("probability")).alias("neighbour"), F.count("*").alias("support"))
    direct = counts.select("src", "dst", F.col("probability").alias("direct"), "count", "source_total")
    both = direct.join(prior, ["src", "dst"], "full")
    has = both.join(direct.select("src").distinct().withColumn("has_direct", F.lit(True)), "src", "left").join(prior.select("src").distinct().withColumn("has_prior", F.lit(True)), "src", "left")
    d, n = F.coalesce("direct", F.lit(0.0)), F.coalesce("neighbour", F.lit(0.0))
    if alpha is None:
        mixed = direct_weight * d + (1 - direct_weight) * n
    else:
        total = F.max("source_total").over(Window.partitionBy("src"))
        mixed = (F.coalesce("count", F.lit(0)) + alpha * n) / (total + alpha)
    score = F.when(F.col("has_direct") & F.col("has_prior"), mixed).when(F.col("has_direct"), d).otherwise(n)
    out = has.select("src", "dst", score.alias("score"), d.alias("direct"), n.alias("neighbour"), F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("count", F.lit(0)).alias("count"))
    return out.filter("score > 0").withColumn("evidence", F.when(F.col("direct") > 0, "direct_transition").otherwise("neighbour_transition"))


def second_order(first: DataFrame, contexts: DataFrame, weight: float = 0.5, alpha: float = 5.0, least: int = 3) -> DataFrame:
    """(previous, current, dst, score) for contexts seen `least` times or more: first-order probabilities
    with a share `weight` moved to the context's own counts, these smoothed by alpha first-order draws."""
    ctx = contexts.filter(F.col("context_total") >= least)
    names = ctx.select("previous", "current", "context_total").distinct()
    base = names.join(first.select(F.col("src").alias("current"), "dst", "probability"), "current")
    both = base.join(ctx.select("previous", "current", "dst", "count"), ["previous", "current", "dst"], "full")
    total = F.max("context_total").over(Window.partitionBy("previous", "current"))
    p, c = F.coalesce("probability", F.lit(0.0)), F.coalesce("count", F.lit(0))
    full = both.withColumn("n", F.coalesce(total, F.sum(c).over(Window.partitionBy("previous", "current"))))
    return full.select("previous", "current", "dst", ((1 - weight) * p + weight * (alpha * p + c) / (F.col("n") + alpha)).alias("score"))


def smooth_grid(counts: DataFrame, neighbours: DataFrame, ks: tuple[int, ...], weights: tuple[float, ...], temperatures: tuple[float, ...]) -> DataFrame:
    """(k, direct_weight, temperature, src, dst, score): `smooth` for every configuration at once.

    k and temperature are columns of the neighbours, so softmax and spreading are done once for all; the
    direct weight is exploded where the two kinds of evidence meet."""
    known = counts.select(F.col("src").alias("nbr")).distinct()
    grid = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("temperature")) for k in ks for t in temperatures])
    w = Window.partitionBy("k", "temperature", "id")
    near = neighbours.join(known, "nbr", "left_semi").withColumn("c", F.explode(grid)).select("id", "nbr", "similarity", "rank", "c.k", "c.temperature").filter("rank <= k")
    e = near.withColumn("e", F.exp((F.col("similarity") - F.max("similarity").over(w)) / F.col("temperature")))
    spread = e.withColumn("w", F.col("e") / F.sum("e").over(w)).join(counts.select(F.col("src").alias("nbr"), "dst", "probability"), "nbr").filter("dst <> id")
    prior = spread.groupBy("k", "temperature", F.col("id").alias("src"), "dst").agg(F.sum(F.col("w") * F.col("probability")).alias("neighbour"))
    direct = counts.select("src", "dst", F.col("probability").alias("direct")).withColumn("c", F.explode(grid)).select("c.k", "c.temperature", "src", "dst", "direct")
    both = direct.join(prior, ["k", "temperature", "src", "dst"], "full")
    by = Window.partitionBy("k", "temperature", "src")
    d, n = F.coalesce("direct", F.lit(0.0)), F.coalesce("neighbour", F.lit(0.0))
    has = both.select("k", "temperature", "src", "dst", d.alias("d"), n.alias("n"), (F.max("direct").over(by).isNotNull()).alias("has_d"), (F.max("neighbour").over(by).isNotNull()).alias("has_n"))
    each = has.withColumn("direct_weight", F.explode(F.array(*map(F.lit, weights))))
    score = F.when(F.col("has_d") & F.col("has_n"), F.col("direct_weight") * F.col("d") + (1 - F.col("direct_weight")) * F.col("n")).when(F.col("has_d"), F.col("d")).otherwise(F.col("n"))
    return each.select("k", "direct_weight", "temperature", "src", "dst", score.alias("score")).filter("score > 0")
