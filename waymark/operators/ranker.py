"""Learning to rank transitions: candidates from seven channels, 33 features, graded labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scoring import scaled_distance
from .transitions import walks
from .vectors import cosine

FEATURES = [
    "probability", "count", "log_count", "log_total", "shrunk", "count_2", "count_3", "count_5", "semantic_p", "semantic_similarity", "semantic_support", "walk_2", "walk_3", "cosine", "vector_missing",
    "same_group", "group_distance", "skill_jaccard", "idf_coverage", "skill_gap", "popularity", "log_popularity", "in_direct", "in_semantic", "in_walk", "in_embedding", "in_skill", "in_popular",
    "aux_p", "aux_count", "aux_log_count", "aux_seen", "in_aux",
]
CHANNELS = ("direct", "semantic", "walk", "embedding", "skill", "popular", "aux")


def _top(scored: DataFrame, channel: str, limit: int) -> DataFrame:
    """(src, dst, channel): the `limit` best of each source by (-score, dst)."""
    w = Window.partitionBy("src").orderBy(F.desc(F.round("score", 9)), "dst")
    return scored.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit).select("src", "dst", F.lit(channel).alias("channel"))


def semantic(counts: DataFrame, neighbours: DataFrame, k: int = 20, temperature: float = 0.05) -> DataFrame:
    """(src, dst, semantic_p, semantic_similarity, semantic_support) from the k nearest roles with transitions."""
    known = counts.select(F.col("src").alias("nbr")).distinct()
    order = Window.partitionBy("id").orderBy("rank")
    near = neighbours.join(known, "nbr", "left_semi").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)
    w = Window.partitionBy("id")
    e = near.withColumn("e", F.exp((F.col("similarity") - F.max("similarity").over(w)) / temperature)).withColumn("w", F.col("e") / F.sum("e").over(w))
    j = e.join(counts.select(F.col("src").alias("nbr"), "dst", "probability"), "nbr").filter("dst <> id")
    return j.groupBy(F.col("id").alias("src"), "dst").agg(F.sum(F.col("w") * F.col("probability")).alias("semantic_p"), F.max("similarity").alias("semantic_similarity"), F.count("*").alias("semantic_support"))


def rows(counts: DataFrame, neighbours: DataFrame, vectors: DataFrame, groups: DataFrame, skills: DataFrame, auxiliary: DataFrame, limit: int = 40) -> DataFrame:
    """(src, dst, *FEATURES) of each source's candidates: the best `limit` of every channel, itself left out.

    counts: (src, dst, count, source_total, probability); neighbours: (id, nbr, similarity, rank); vectors:
    (id, vec); groups: (id, g), all roles; skills: (role, skill, idf); auxiliary: (src, dst, count) of another
    dataset. No label takes part, so labels never widen the candidates. Only the popular channel meets every source, with
    its `limit` rows."""
    near = semantic(counts, neighbours)
    w = walks(counts, 3)
    step = lambda i: w.filter(F.col("step") == i).select("src", "dst", F.col("p").alias(f"walk_{i}"))
    two, three = step(2), step(3)
    popular = counts.groupBy("dst").agg(F.sum("count").alias("dest_count"))
    total = counts.agg(F.sum("count").alias("all"))
    s = skills.select("role", "skill", "idf")
    shared = s.select(F.col("role").alias("src"), "skill", "idf").join(s.select(F.col("role").alias("dst"), "skill"), "skill").filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("both"), F.sum("idf").alias("score"))
    size = s.groupBy("role").agg(F.count("*").alias("n"), F.sum("idf").alias("all_idf"))
    aux = auxiliary.withColumn("aux_total", F.sum("count").over(Window.partitionBy("src"))).select("src", "dst", F.col("count").alias("aux_count"), (F.col("count") / F.col("aux_total")).alias("aux_p"))
    walk = two.join(three, ["src", "dst"], "full").na.fill(0.0)
    first = popular.orderBy(F.desc("dest_count"), "dst").limit(limit).select("dst")
    parts = [
        _top(counts.withColumn("score", F.col("probability")), "direct", limit), _top(near.withColumn("score", F.col("semantic_p")), "semantic", limit), _top(walk.withColumn("score", F.col("walk_2") + 0.25 * F.col("walk_3")), "walk", limit),
        neighbours.select(F.col("id").alias("src"), F.col("nbr").alias("dst"), F.lit("embedding").alias("channel")), _top(shared, "skill", limit),
        groups.select(F.col("id").alias("src")).join(F.broadcast(first), F.lit(True)).select("src", "dst", F.lit("popular").alias("channel")), _top(aux.withColumn("score", F.col("aux_p")), "aux", limit),
    ]
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    c = every.filter("src <> dst").groupBy("src", "dst").agg(*[F.max((F.col("channel") == x).cast("double")).alias(f"in_{x}") for x in CHANNELS])
    sums = counts.groupBy("src").agg(F.max("source_total").alias("source_total"))
    v = vectors.select("id", "vec")
    side = lambda df, key, to, **names: df.select(F.col(key).alias(to), *[F.col(a).alias(b) for b, a in names.items()])
    j = (
        c.join(counts.select("src", "dst", "count", "probability"), ["src", "dst"], "left").join(sums, "src", "left").join(near, ["src", "dst"], "left").join(walk, ["src", "dst"], "left")
        .join(side(v, "id", "src", va="vec"), "src", "left").join(side(v, "id", "dst", vb="vec"), "dst", "left").join(side(groups, "id", "src", ga="g"), "src", "left").join(side(groups, "id", "dst", gb="g"), "dst", "left")
        .join(shared, ["src", "dst"], "left").join(side(size, "role", "src", na="n"), "src", "left").join(side(size, "role", "dst", nb="n", ib="all_idf"), "dst", "left")
        .join(popular, "dst", "left").crossJoin(F.broadcast(total)).join(aux, ["src", "dst"], "left")
    )
    zero = lambda x: F.coalesce(F.col(x).cast("double"), F.lit(0.0))
    n, both, nb = zero("count"), zero("both"), zero("nb")
    flag = lambda x: x.cast("double")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    values = {
        "probability": zero("probability"), "count": n, "log_count": F.log1p(n), "log_total": F.log1p(zero("source_total")), "shrunk": F.when(zero("source_total") > 0, n / (zero("source_total") + 5)).otherwise(0.0),
        "count_2": flag(n >= 2), "count_3": flag(n >= 3), "count_5": flag(n >= 5), "semantic_p": zero("semantic_p"), "semantic_similarity": zero("semantic_similarity"), "semantic_support": zero("semantic_support"),
        "walk_2": zero("walk_2"), "walk_3": zero("walk_3"), "cosine": F.coalesce(cosine(F.col("va"), F.col("vb")), F.lit(0.0)), "vector_missing": flag(F.col("va").isNull() | F.col("vb").isNull()),
        "same_group": flag(F.coalesce(F.col("ga") == F.col("gb"), F.lit(False))), "group_distance": scaled_distance(F.col("ga"), F.col("gb")), "skill_jaccard": share(both, zero("na") + nb - both),
        "idf_coverage": share(zero("score"), zero("ib")), "skill_gap": share(nb - both, nb), "popularity": share(zero("dest_count"), zero("all")), "log_popularity": F.log1p(zero("dest_count")),
        "aux_p": zero("aux_p"), "aux_count": zero("aux_count"), "aux_log_count": F.log1p(zero("aux_count")), "aux_seen": flag(zero("aux_count") > 0),
    }
    return j.select("src", "dst", *[values.get(f, F.col(f)).alias(f) for f in FEATURES])


def graded(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """candidates with grade: 0 for never observed, 1 for once, 2 for two or three times, 3 for more."""
    n = F.coalesce("truth", F.lit(0))
    j = candidates.join(truth.select("src", "dst", F.col("count").alias("truth")), ["src", "dst"], "left")
    return j.withColumn("grade", F.when(n >= 4, 3).when(n >= 2, 2).when(n >= 1, 1).otherwise(0)).drop("truth")


def recall(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: queries, rows, rows with a grade, observed transitions of the queries, and how many of these are candidates."""
    q = candidates.select("src").distinct()
    seen = truth.join(q, "src", "left_semi").join(candidates.select("src", "dst", F.lit(True).alias("has")), ["src", "dst"], "left")
    t = seen.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("truth"), F.coalesce(F.sum(F.when(F.col("has"), F.col("count"))), F.lit(0)).alias("recalled"))
    return candidates.agg(F.countDistinct("src").alias("queries"), F.count("*").alias("rows"), F.count_if(F.col("grade") > 0).alias("positive_rows")).crossJoin(t)
