"""Alternatives drawn for observed steps, their weights, the distributed fit and the parts of effort against plain versions."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from waymark.operators import calibration as cal


def roles_of(n, groups=5):
    return [(f"r{i:03d}", f"{10 + i % groups}" if i % 17 else None, i % 3 == 0) for i in range(n)]


def test_alternatives_are_drawn_from_strata_without_replacement(spark):
    rows = roles_of(120) + [("solo", "99", False)]
    roles = spark.createDataFrame(rows, "role string, grp string, popular boolean")
    names = [r[0] for r in rows]
    events = [(f"e{i}", names[i % 121], names[(i * 7 + 1) % 121]) for i in range(300)] + [("s", "solo", "r001"), ("n", "r000", "r017")]
    events = [e for e in events if e[1] != e[2]]
    df = spark.createDataFrame(events, "event string, src string, dst string")
    take = (6, 5, 4)
    got = defaultdict(lambda: defaultdict(list))
    rows_out = cal.sample_alternatives(df, roles, take).collect()
    for r in rows_out:
        got[r.event][r.stratum].append((r.role, r.weight))
    group, popular = {r[0]: r[1] for r in rows}, {r[0] for r in rows if r[2]}
    for event, src, dst in events:
        drawn = [x for k in range(3) for x, _ in got[event][k]]
        assert len(drawn) == len(set(drawn))
        near = {x for x in names if group[src] and group[x] == group[src]} - {src, dst} or set(names) - {src, dst}
        chosen = set()
        for k, pool in enumerate((near, popular, set(names) - {src, dst})):
            left = pool - chosen
            mine = [x for x, _ in got[event][k]]
            assert len(mine) == min(take[k], len(left)) and set(mine) <= left
            assert all(w == pytest.approx(len(left) / len(mine)) for _, w in got[event][k])
            chosen |= set(mine)
    again = cal.sample_alternatives(df.repartition(7), roles.repartition(3), take).collect()
    assert sorted(map(tuple, rows_out)) == sorted(map(tuple, again))


def test_every_role_is_drawn_about_equally_often(spark):
    roles = spark.createDataFrame([(f"r{i}", None, False) for i in range(40)], "role string, grp string, popular boolean")
    events = spark.createDataFrame([(f"e{i}", "r0", "r1") for i in range(2000)], "event string, src string, dst string")
    n = Counter(r.role for r in cal.sample_alternatives(events, roles, (5, 0, 5)).collect())
    assert len(n) == 38 and sum(n.values()) == 20_000
    assert all(abs(x - 20_000 / 38) < 120 for x in n.values())


def plain_fit(d, w, steps=500, rate=0.1, ridge=1e-3):
    w, beta = w / w.sum(), np.full(4, 0.25)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ beta, -40, 40)))
        beta = np.maximum(0, beta - rate * (d.T @ (w * p) + ridge * beta))
        beta = beta / beta.sum() if beta.sum() > 1e-12 else np.full(4, 0.25)
    return beta


def test_distributed_fit_equals_numpy_on_all_pairs(spark):
    r = np.random.default_rng(1)
    d = r.normal(size=(3000, 4)) * 0.6 + np.array([-0.3, -0.05, -0.15, 0.1])
    w = r.uniform(0.5, 9, 3000)
    df = spark.createDataFrame([(*map(float, x), float(y)) for x, y in zip(d, w)], "d_gap double, d_domain double, d_unsupported double, d_transfer double, weight double").repartition(3)
    beta, n = cal.descend(df, 60)
    want = plain_fit(d, w, 60)
    assert n == 3000 and np.allclose(beta, want, atol=1e-9) and 0 < want[1] < want[0]
    assert cal.descend(df.limit(0))[1] == 0


def test_parts_of_a_known_case(spark):
    sk = {"a": 2.0, "b": 1.0, "c": 0.5, "z": 0.0}
    pick = lambda x: [(k, sk[k]) for k in x]
    roles = spark.createDataFrame([("r1", "1100", pick("ab")), ("r2", "1120", pick("bc")), ("r3", "2100", pick("c")), ("r4", None, pick("a")), ("r5", "1100", []), ("r6", "1100", pick("z"))], "role string, grp string, skills array<struct<skill:string,idf:double>>")
    owned = spark.createDataFrame([("e", pick("ab")), ("f", [])], "event string, skills array<struct<skill:string,idf:double>>")
    support = spark.createDataFrame([("r1", "r2", 0.25)], "src string, role string, support double")
    pairs = spark.createDataFrame([("e", "r1", x) for x in ("r2", "r3", "r4", "r5", "r6")] + [("f", "r1", "r2"), ("e", "r5", "r2")], "event string, src string, role string")
    got = {(r.event, r.src, r.role): (r.gap, r.domain, r.unsupported, r.transfer) for r in cal.step_features(pairs, owned, roles, support).collect()}
    assert got == {
        ("e", "r1", "r2"): (pytest.approx(0.5 / 1.5), 0.5, 0.75, pytest.approx(0.5 / 1.5)), ("e", "r1", "r3"): (1.0, 1.0, 1.0, 1.0),
        ("e", "r1", "r6"): (0.0, 0.0, 1.0, 1.0), ("e", "r5", "r2"): (pytest.approx(0.5 / 1.5), 0.5, 1.0, 1.0),
    }


def test_limits_and_defaults(spark):
    cols = "gap double, domain double, unsupported double, transfer double"
    some = spark.createDataFrame([(0.1, 0.1, 0.1, 0.1), (0.4, 0.4, 0.4, 0.4), (0.7, 0.7, 0.7, 0.7), (1.0, 1.0, 1.0, 1.0)], cols)
    d = spark.createDataFrame([(-0.5, 0.2, 0.1, 0.1, 2.0), (-0.4, 0.1, 0.2, 0.0, 1.0)], "d_gap double, d_domain double, d_unsupported double, d_transfer double, weight double")
    rows = cal.calibration(spark, d, some, 40).collect()
    assert {r.part for r in rows} == set(cal.PARTS) and sum(r.weight for r in rows) == pytest.approx(1, abs=1e-5)
    assert {(r.low_max, r.moderate_max, r.pairs, r.origin) for r in rows} == {(0.4, 0.7, 2, "learnt")}
    assert max(rows, key=lambda r: r.weight).part == "gap"
    none = cal.calibration(spark, d.limit(0), some).collect()
    assert [(r.weight, r.low_max, r.moderate_max, r.origin) for r in none] == [(w, 0.3, 0.6, "default") for w in cal.DEFAULT["weights"]]
    assert {r.origin for r in cal.calibration(spark, d, some.limit(2), 5).collect()} == {"default"}


def test_draws_of_events_are_not_shuffled_and_equal_differences_are_one(spark):
    roles = spark.createDataFrame(roles_of(60), "role string, grp string, popular boolean")
    events = spark.createDataFrame([(f"e{i}", f"r{i % 60:03d}", f"r{(i * 7 + 1) % 60:03d}", i % 3) for i in range(200)], "event string, src string, dst string, kind long")
    one = cal.sample_alternatives(events, roles, (6, 5, 4))
    by = cal.sample_alternatives(events, roles, (6, 5, 4), by=("kind",))
    assert sorted((r.event, r.role, r.stratum, r.weight) for r in by.collect()) == sorted(map(tuple, one.collect()))
    plan = one._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan
    part = lambda *v: ("e", *map(float, v))
    names = "event string, " + ", ".join(f"{c} double" for c in cal.PARTS)
    alternatives = spark.createDataFrame([(*part(1, 0, 0, 0), 2.0), (*part(1, 0, 0, 0), 3.0), (*part(0, 1, 0, 0), 1.0)], names + ", weight double")
    d = cal.differences(spark.createDataFrame([part(0, 0, 0, 0)], names), alternatives)
    assert sorted((r.d_gap, r.weight, r.n) for r in d.collect()) == [(-1.0, 5.0, 2), (0.0, 1.0, 1)] and cal.descend(d, 3)[1] == 3
