"""Lambda gradients, boosting on them, fusion of all sizes at once and the gate, against plain versions."""

import math

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from waymark.operators import lambda_rank as lr
from waymark.operators import scoring


def test_lambdas_equal_a_sum_over_pairs():
    r = np.random.default_rng(3)
    for _ in range(20):
        n = int(r.integers(1, 12))
        grades, scores, tie = r.integers(0, 4, n), r.integers(0, 3, n).astype(float), r.permutation(n)
        g, w = lr.lambdas(grades, scores, tie)
        order = sorted(range(n), key=lambda i: (-scores[i], tie[i]))
        place = {i: k for k, i in enumerate(order)}
        gain = [lr.GAINS[x] for x in grades]
        ideal = sum(x / math.log2(k + 2) for k, x in enumerate(sorted(gain, reverse=True)))
        want, weight = [0.0] * n, [0.0] * n
        for i in range(n):
            for j in range(n):
                if gain[i] > gain[j]:
                    delta = abs((gain[i] - gain[j]) * (1 / math.log2(place[i] + 2) - 1 / math.log2(place[j] + 2))) / ideal
                    rho = 1 / (1 + math.exp(scores[i] - scores[j]))
                    want[i] += delta * rho
                    want[j] -= delta * rho
                    weight[i] += delta * rho * (1 - rho)
                    weight[j] += delta * rho * (1 - rho)
        assert g == pytest.approx(want) and w == pytest.approx(weight)


def ndcg(ranked, truth):
    by = {}
    for r in ranked:
        by.setdefault(r.src, []).append((r.rank, lr.GAINS[truth[r.src, r.dst]]))
    out = []
    for rows in by.values():
        ideal = sum(g / math.log2(k + 2) for k, g in enumerate(sorted((g for _, g in rows), reverse=True)))
        if ideal:
            out.append(sum(g / math.log2(k + 1) for k, g in rows) / ideal)
    return sum(out) / len(out)


def test_lambdas_rank_better_than_grades_one_by_one(spark):
    """Sources differ in level: what is high in one is low in another, and one feature tells rows of a list apart."""
    r = np.random.default_rng(5)
    rows, truth = [], {}
    for s in range(120):
        level = float(r.normal() * 3)
        for c in range(12):
            x = float(r.normal())
            grade = int(np.clip(round(1.1 * x + r.normal() * 0.3), 0, 3)) if s % 4 else int(3 * (x > 0.2))
            grade = grade if level > 0 else min(grade, 1)
            rows.append((f"s{s}", f"d{c}", [x, level, float(r.normal())], grade))
            truth[f"s{s}", f"d{c}"] = grade
    df = spark.createDataFrame(rows, "src string, dst string, features array<double>, grade int").withColumn("test", F.pmod(F.xxhash64("src"), F.lit(2)) == 0)
    learn, test = df.filter("not test"), df.filter("test")
    config = lr.Boosting(3, 5, 0.4)
    got = lr.ranked(test, lr.fit(learn, config), config.rate).collect()
    plain = GBTRegressor(featuresCol="v", labelCol="grade", maxDepth=3, maxIter=5, seed=7).fit(learn.withColumn("v", array_to_vector("features")))
    pointwise = plain.transform(test.withColumn("v", array_to_vector("features")))
    from pyspark.sql import Window

    point = pointwise.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("prediction"), "dst"))).collect()
    assert ndcg(got, truth) > ndcg(point, truth) > 0.5
    assert lr.fit(learn.withColumn("grade", F.lit(0)), config) == []
    with pytest.raises(ValueError, match="no columns q"):
        lr.packed(df, ["q"])


def test_lists_of_one_grade_teach_nothing(spark):
    rows = [(s, f"d{i}", [float(i), 1.0], 3) for s in ("a", "b") for i in range(5)]
    same = spark.createDataFrame(rows, "src string, dst string, features array<double>, grade int")
    config = lr.Boosting(2, 2)
    assert lr.fit(same, config) == []
    mixed = spark.createDataFrame([("c", f"d{i}", [float(i), 1.0], i % 2) for i in range(6)], same.schema)
    trees = lambda df: [t.toDebugString.split("\n", 1)[1] for t in lr.fit(df, config)]
    assert len(trees(mixed)) == 2 and trees(same.unionByName(mixed)) == trees(mixed)


def test_fusion_grid_equals_one_fusion_after_the_other(spark):
    r = np.random.default_rng(9)
    lists = lambda n: [(f"s{s}", f"d{c}", k + 1) for s in range(6) for k, c in enumerate(r.permutation(30)[:n])]
    a, z = (spark.createDataFrame(lists(n), "src string, dst string, rank int") for n in (9, 14))
    grid = lr.fusion_grid(a, z, (1, 3, 20), (1, 5)).collect()
    for head in (1, 3, 20):
        for slots in (1, 5):
            ids = lambda df: df.select(F.col("src").alias("query_id"), F.col("dst").alias("id"), "rank")
            want = {(x.query_id, x.id, x.rank) for x in scoring.head_fusion(ids(a), ids(z), head, slots).collect()}
            assert {(x.src, x.dst, x.rank) for x in grid if (x.head, x.slots) == (head, slots)} == want


def test_metrics_choice_and_gate(spark):
    held = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("b", "x", 2), ("c", "q", 4)], "src string, dst string, count long")
    p = spark.createDataFrame([(1, "a", "x", 1), (1, "a", "y", 2), (1, "b", "z", 1), (2, "a", "y", 1), (2, "a", "x", 2), (2, "b", "x", 6), (2, "c", "q", 2)], "k int, src string, dst string, rank int")
    m = {r.k: r for r in lr.metrics_by(p, held, ["k"]).collect()}
    assert (m[1].mrr, m[1].hits_5, m[1].hits_10, m[1].source_role_coverage, m[1].destination_coverage) == (0.35, 0.4, 0.4, pytest.approx(2 / 3), 0.4)
    assert m[1].macro_mrr == pytest.approx(3.5 / 4 / 3) and m[2].hits_5 == 0.8 and m[2].hits_10 == 1.0
    assert [r.k for r in lr.best(lr.metrics_by(p, held, ["k"]), ["k"]).collect()] == [2]
    both = p.withColumn("stage", F.when(F.col("k") == 1, "before").otherwise("after"))
    rows = lr.metrics_by(both, held, ["stage"])
    every = rows.withColumn("split", F.lit("test")).unionByName(rows.withColumn("split", F.lit("validation")))
    assert [tuple(r)[:2] for r in lr.gate(every).collect()] == [(True, "")]
    turned = every.withColumn("stage", F.when(F.col("stage") == "before", "after").otherwise("before"))
    bad = lr.gate(turned).first()
    assert not bad.accepted and bad.reasons.split("; ")[:3] == ["validation mrr does not improve", "test mrr does not improve", "no test hits improve"] and "source_role_coverage falls" in bad.reasons
    assert not lr.gate(every.filter("split = 'test'")).first().accepted
