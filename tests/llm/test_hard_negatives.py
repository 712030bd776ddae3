"""Mined negatives against scores of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import entries
from waymark.llm.hard_negatives import Best, Sizes, buckets_of, hard_negatives as mine, search


def plain(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    out = []
    width = max(len(v) for _, _, v in rows)
    rows = [(i, lab, np.array([*v, *[0] * (width - len(v))], dtype=np.int64)) for i, lab, v in rows]
    for a, lab, v in rows:
        if not is_anchor(a):
            continue
        scored = sorted(((-int(v @ w), i, x) for i, x, w in rows if i != a))
        for s, p, _ in [x for x in scored if x[2] == lab][:positives]:
            near = [(i, -n) for n, i, x in scored if x != lab and low * -s <= 100 * -n <= high * -s]
            out += [(a, p, k + 1, i, -s, n) for k, (i, n) in enumerate(near[:negatives])]
    return sorted(out)


def made(n, width, seed, spread=40, labels=4):
    """Vectors around a few centres, of many lengths, with ties and with one vector that many rows share."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(labels + 2, width)) * 60
    v = np.floor(centres[r.integers(0, len(centres), n)] + r.normal(size=(n, width)) * r.choice([1, 5, spread], n)[:, None]) * r.integers(1, 4, n)[:, None]
    v[:: 9] = v[0]
    v[5] = 0
    lab = r.integers(0, labels, n)
    return [(int(i), int(x), [float(y) for y in z]) for i, x, z in zip(r.permutation(3 * n)[:n], lab, v)]


@pytest.mark.parametrize("sizes", [Sizes(), Sizes(unit_rows=40, block_anchors=7, bucket_rows=16), Sizes(unit_rows=500, bucket_rows=30, focus=8, dense=1.0)])
def test_rows_equal_all_pairs(spark, sizes):
    rows = made(400, 8, 1)
    df = spark.createDataFrame(rows, "vec_id long, label int, vec array<double>")
    got = sorted(map(tuple, mine(df, F.col("vec_id") % 5 == 0, sizes=sizes).collect()))
    assert got == plain(rows, lambda i: i % 5 == 0)


def test_pruning_is_exact_and_leaves_rows_out():
    r = np.random.default_rng(4)
    z = np.floor(np.repeat(r.normal(size=(40, 6)) * 300, 50, 0) + r.normal(size=(2000, 6)) * 4)
    ids = r.permutation(2000)
    lists, skipped, all_rows = buckets_of(ids, np.zeros(2000, int), z, 256), 0, 0
    for q in z[:60]:
        scores = z @ q
        for low, high in ((-np.inf, np.inf), (np.quantile(scores, 0.9), np.quantile(scores, 0.95)), (-50.0, 50.0), (np.quantile(scores, 0.01), np.quantile(scores, 0.02)), (0.0, 0.0)):
            w = Best(7, low, high)
            search(lists, q, [w], lambda b: np.ones(len(b.ids), bool), Sizes(bucket_rows=256))
            hit = (scores >= low) & (scores <= high)
            want = sorted(zip(-scores[hit], ids[hit]))[:7]
            assert [(-s, i) for s, i in zip(w.scores, w.ids)] == want
        top = np.sort(scores)[-7]
        for b in lists:
            rows = b.candidates(q, float(np.sqrt(q @ q)), np.argsort(-np.abs(q))[:4], float(top), np.inf, 0.5)
            all_rows += len(b.ids)
            skipped += 0 if rows is None else len(b.ids) - len(rows)
    assert skipped > 0.8 * all_rows


def test_odd_rows(spark):
    rows = [
        (0, 1, [3.0, 4.0], 1), (1, 1, [3.0, 4.0], 1), (1, 1, [3.0, 4.0], 2), (2, 2, [2.0, 2.0], 1), (3, 2, [4.0], 1), (4, 2, [3.0, 2.0], 1), (8, 3, [3.0, 2.0], 1),
        (5, None, [3.0, 3.0], 1), (6, 2, None, 1), (7, 2, [3.0, None], 1), (None, 2, [3.0, 2.0], 1), (9, 1, [], 1), (10, 7, [1.0, 1.0], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, label int, vec array<double>, id int")
    got = sorted(map(tuple, mine(df, F.col("vec_id") % 10 == 0).collect()))
    good = [(i, lab, v) for i, lab, v in ((0, 1, [3, 4]), (1, 1, [3, 4]), (2, 2, [2, 2]), (3, 2, [4]), (4, 2, [3, 2]), (8, 3, [3, 2]), (9, 1, []), (10, 7, [1, 1]))]
    assert got == plain(good, lambda i: i % 10 == 0) and (0, 1, 1, 4, 25.0, 17.0) in got and (0, 1, 2, 8, 25.0, 17.0) in got
    assert mine(df.limit(0), F.col("vec_id") % 10 == 0).collect() == []


def test_query_equals_the_contract(spark, tmp_path):
    r = np.random.default_rng(6)
    n = 300
    v = r.normal(size=(n, 16)).astype(np.float32)
    v[::7] = v[3]
    rows = [(i, [float(x) for x in v[i]], int(r.integers(0, 10))) for i in range(n)] + [(350, None, 1), (400, [float("nan")] * 16, 1), (450, [float("inf")] + [0.0] * 15, 2), (500, [0.5] * 16, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, entries.op12_hard_negatives(spark, str(tmp_path)).collect()))
    good = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [int(np.floor(256 * np.float64(np.float32(x)))) for x in e]) for i, e, lab in rows[:n]]
    assert got == plain(good, lambda i: i % 50 == 0) and len(got) > 20
    assert all(isinstance(x, int) for row in got for x in row)
