"""Connected components against union-find, and groups that only a long chain holds together."""

import random

import pytest

from waymark.llm import components as c
from waymark.llm import ngram_join as nj
from waymark.llm.components import components


def plain(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def found(spark, edges):
    return {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}


def test_path_of_random_ids_ends_soon(spark, monkeypatch):
    rounds, step = [], c._small_star
    monkeypatch.setattr(c, "_small_star", lambda e: rounds.append(1) or step(e))
    rng = random.Random(3)
    ids = [rng.randrange(-(2**62), 2**62) for _ in range(10_000)]
    assert found(spark, list(zip(ids, ids[1:], strict=False))) == dict.fromkeys(ids, min(ids))
    assert len(rounds) <= 20


def test_a_graph_that_fits_a_partition_is_known_before_the_first_step(spark, monkeypatch):
    rounds, step = [], c._small_star
    monkeypatch.setattr(c, "_small_star", lambda e: rounds.append(1) or step(e))
    rng = random.Random(4)
    ids = rng.sample(range(2**40), 10_000)
    assert found(spark, list(zip(ids, ids[1:], strict=False)) + [(-1, -1)]) == {**dict.fromkeys(ids, min(ids)), -1: -1}
    assert len(rounds) == 1


@pytest.mark.parametrize("held", [1, 40, 500])
def test_edges_of_a_partition_in_several_parts(spark, monkeypatch, held):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(c, "_HELD", held)
    rng = random.Random(held)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(400)]

    class Frame:
        def mapInArrow(self, run, schema):
            batches = [pa.RecordBatch.from_pydict({"u": [a for a, _ in edges[i : i + 30]], "v": [b for _, b in edges[i : i + 30]]}) for i in range(0, len(edges), 30)]
            return np.concatenate([np.stack([x.to_numpy() for x in out.columns]) for out in run(iter(batches))], axis=1)

    assert plain(c._contract(Frame()).T.tolist()) == plain(edges)


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(7, 7), (99, 99)]
    assert found(spark, edges + edges[:5]) == plain(edges)


def test_stars_joined_loops_nulls_and_nothing(spark):
    edges = [(500, i) for i in range(100)] + [(600, i) for i in range(200, 300)] + [(99, 200)]
    assert set(found(spark, edges).values()) == {0}
    assert found(spark, [(5, 5), (None, 3), (4, None)]) == {5: 5}
    assert found(spark, []) == {}


def test_a_chain_of_revisions_is_one_group(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**9)}" for _ in range(60 + 2 * 120)]
    docs = [(i, " ".join(words[2 * i : 2 * i + 60])) for i in range(120)]
    rows = nj.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.component_id for r in rows} == {0} and len(rows) == 120


def test_a_column_that_clashes_with_names_inside(spark):
    docs = spark.createDataFrame([(1, "a b c d e", 7), (2, "a b c d e", 8), (3, None, 9)], "doc_id long, text string, _id int")
    assert [(r.doc_id, r._id) for r in nj.representatives(docs).orderBy("doc_id").collect()] == [(1, 7), (3, 9)]


def test_sketches_never_overstate_what_sets_differ_in():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, k in ((5, 3), (100, 20), (1000, 150), (3000, 0)):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate((a[k:], rng.integers(0, 1 << 63, k // 2, dtype=np.uint64)))
        x, y = nj.sketch(a), nj.sketch(b)
        least = min(len(x), len(y))
        for size in (least, least // 2):
            apart = int(np.bitwise_count(nj.folded(x, size) ^ nj.folded(y, size)).sum())
            assert apart <= len(np.setxor1d(a, b))
        assert int(np.bitwise_count(x ^ x).sum()) == 0
