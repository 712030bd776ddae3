"""Vectors, transition models, metrics, graph and scoring: literal cases with known values."""

import datetime
import math
import re
import uuid

import pytest
from pyspark.sql import functions as F

from waymark.operators import evaluation as ev
from waymark.operators import graph as g
from waymark.operators import models
from waymark.operators import phrases as ph
from waymark.operators import scoring as sc
from waymark.operators import stores as st
from waymark.operators import text as x
from waymark.operators import transitions as tr
from waymark.operators import vectors as v

COUNTS = "src string, dst string, count long, source_total long, probability double"


def test_vectors_are_cleaned(spark):
    rows = [("m", [5.0, -12.0]), ("n", [1.0, float("inf")]), ("o", []), ("p", [0.0, 0.0]), ("q", None), ("r", [1.0, 2.0, 3.0])]
    vec = spark.createDataFrame(rows, "id string, vec array<float>")
    assert [(r.id, r.vec) for r in v.normalised(vec, 2).collect()] == [("m", [pytest.approx(5 / 13), pytest.approx(-12 / 13)])]
    ids = spark.createDataFrame([(x,) for x in "mnopqrstu"], "id string")
    assert tuple(v.load_report(ids, vec, 2).first()) == (9, 1, 3, 5)


@pytest.mark.parametrize("block", [2048, 2])
def test_neighbours_exclude_self_and_break_ties_by_id(spark, block, monkeypatch):
    monkeypatch.setattr(v, "BLOCK", block)
    rows = [("k", [0.0, 2.0]), ("d", [0.6, 0.8]), ("c", [-0.6, 0.8]), ("f", [1.0, 0.0]), ("e", [0.0, -1.0])]
    vec = v.normalised(spark.createDataFrame(rows, "id string, vec array<double>"))
    got = v.nearest(vec.filter("id = 'k'"), vec, 3).orderBy("rank").collect()
    assert [(r.nbr, r.similarity) for r in got] == [("c", 0.8), ("d", 0.8), ("f", 0.0)]
    assert v.nearest(vec.limit(0), vec, 3).collect() == []
    pairs = v.similar_pairs(vec, vec, 0.8, inclusive=True).filter("id < nbr").collect()
    assert sorted((r.id, r.nbr) for r in pairs) == [("c", "k"), ("d", "k")]


def test_sweep_counts_without_pairs(spark):
    a = v.normalised(spark.createDataFrame([("1", [1.0, 0.0]), ("2", [0.0, 1.0])], "id string, vec array<double>")).withColumn("group", F.when(F.col("id") == "1", "g").otherwise("h"))
    got = {r.threshold: r for r in v.threshold_sweep(a, a.withColumn("id", F.concat(F.lit("x"), "id")), [0.0, 0.5]).collect()}
    assert (got[0.0].predicted, got[0.0].true, got[0.5].predicted, got[0.5].true, got[0.5].f1) == (4, 2, 2, 2, 1.0)
    assert got[0.5].best and not got[0.0].best


def test_smoothing(spark):
    c = spark.createDataFrame([("go", "up", 6, 12, 0.5), ("by", "up", 2, 8, 0.25), ("by", "in", 6, 8, 0.75)], COUNTS)
    near = spark.createDataFrame([("go", "by", 0.9, 1), ("off", "by", 0.4, 1)], "id string, nbr string, similarity double, rank int")
    got = {(r.src, r.dst): r for r in tr.smooth(c, near, 0.8).collect()}
    assert got["go", "up"].score == pytest.approx(0.45) and got["go", "in"].score == pytest.approx(0.15)
    assert got["off", "in"].score == pytest.approx(0.75) and got["off", "in"].evidence == "neighbour_transition"
    eb = {(r.src, r.dst): r.score for r in tr.smooth(c, near, alpha=4.0).collect()}
    assert (eb["go", "up"], eb["go", "in"]) == (pytest.approx(7 / 16), pytest.approx(3 / 16))
    grid = {(r.direct_weight, r.src, r.dst): r.score for r in tr.smooth_grid(c, near, (1,), (0.8, 0.5), (0.06,)).collect()}
    assert grid[0.8, "go", "up"] == pytest.approx(0.45) and grid[0.5, "go", "in"] == pytest.approx(0.375) and grid[0.5, "off", "up"] == pytest.approx(0.25)


def test_walks_and_blend(spark):
    c = spark.createDataFrame([("n", "e", 6, 10, 0.6), ("n", "w", 4, 10, 0.4), ("e", "n", 5, 10, 0.5), ("e", "s", 5, 10, 0.5), ("w", "s", 7, 7, 1.0), ("s", "x", 1, 1, 1.0)], COUNTS)
    got = {(r.dst, r.step): r.p for r in tr.walks(c, 3).filter("src = 'n'").collect()}
    assert got == {("e", 1): 0.6, ("w", 1): 0.4, ("s", 2): pytest.approx(0.7), ("x", 3): pytest.approx(0.7)}
    mixed = {r.dst: r.score for r in tr.blend(tr.walks(c, 2), {1: 0.5, 2: 0.5}).filter("src = 'n'").collect()}
    assert mixed == {"e": pytest.approx(0.3), "w": pytest.approx(0.2), "s": pytest.approx(0.35)}
    with pytest.raises(ValueError):
        tr.blend(tr.walks(c, 2), {1: 0.8})


def test_only_training_transitions_pass(spark):
    rows = [("TRANSITIONS_TO", "trajectory", s) for s in ("train", None, "test", "validation")] + [("SIMILAR_TO", "trajectory", "train"), ("TRANSITIONS_TO", "other", None)]
    assert spark.createDataFrame(rows, "relation string, source string, split string").filter(tr.is_training()).count() == 2


def test_heldout_metrics(spark):
    p = spark.createDataFrame([("g", "h", 2), ("g", "i", 1), ("k", "l", 4)], "src string, dst string, rank int")
    h = spark.createDataFrame([("g", "h", 3), ("g", "z", 1), ("k", "l", 2), ("m", "l", 4)], "src string, dst string, count long")
    m = ev.heldout_metrics(p, h, (1, 3)).first()
    assert (m.observations, m.mrr, m.hits_1, m.hits_3, m.observation_coverage) == (10, 0.2, 0.0, 0.3, 0.6)
    assert m.source_role_coverage == pytest.approx(2 / 3) and m.covered_only_mrr == pytest.approx(2 / 6)


def test_coverage_asks_for_any_prediction(spark):
    p = spark.createDataFrame([("g", "h", 1)], "src string, dst string, rank int")
    e = spark.createDataFrame([(1, "g", "h"), (1, "g", "other"), (2, "k", "h")], "person long, src string, target string")
    assert sorted((r.rr, r.covered) for r in ev.event_values(e, p).collect()) == [(0.0, False), (0.0, True), (1.0, True)]


def test_bands(spark):
    rows = lambda *x: spark.createDataFrame([(float(y),) for y in x], "s double")
    assert tuple(ev.band_thresholds(rows(0.1, 0.2, 0.3, 0.4, float("nan")), "s").first()) == (pytest.approx(0.2), pytest.approx(0.3))
    assert tuple(ev.band_thresholds(rows(0.5, 0.5, 0.5), "s").first()) == (0.5, pytest.approx(0.5 + 1e-6))
    assert tuple(ev.band_thresholds(rows(-3, -2, 7, 9), "s").first()) == (0.0, 1.0)
    with pytest.raises(Exception, match="three scores"):
        ev.band_thresholds(rows(0.5, 0.6), "s").collect()


def test_paired_bootstrap_draws_both_sides_alike(spark):
    a = spark.createDataFrame([(i % 20, 0.5 if i % 3 else 0.2) for i in range(200)], "person long, rr double")
    same = ev.paired_bootstrap(a, a, ("rr",), 50).first()
    assert (same.gain, same.low, same.high, same.better) == (0.0, 0.0, 0.0, 0.0)
    more = ev.paired_bootstrap(a, a.withColumn("rr", F.col("rr") + 0.25), ("rr",), 50).first()
    # a constant gain has no spread, however the people differ
    assert (more.gain, more.low, more.high, more.better) == (pytest.approx(0.25), pytest.approx(0.25), pytest.approx(0.25), 1.0)


def test_inversions_of_long_lists(spark):
    import random

    r = random.Random(2)
    lists = {"a": [r.random() for _ in range(100_000)], "b": [r.randrange(5) / 4 for _ in range(300)], "c": [1.0] * 50, "d": [float(-i) for i in range(40)], "e": [0.5]}
    rows = spark.createDataFrame([(k, i + 1, x) for k, of in lists.items() for i, x in enumerate(of)], "case string, rank int, accessibility double")
    got = {x.case: x.inversions for x in ev.inversions(rows, ["case"], "rank", "accessibility").collect()}

    def sorted_count(of):
        """Pairs in order of value, by merging halves."""
        if len(of) < 2:
            return of, 0
        (a, n), (z, m) = sorted_count(of[: len(of) // 2]), sorted_count(of[len(of) // 2 :])
        out, i, k = [], 0, n + m
        for y in z:
            while i < len(a) and a[i] < y:
                out.append(a[i])
                i += 1
            k += i
            out.append(y)
        return sorted(a + z), k

    assert got == {k: sorted_count(of)[1] for k, of in lists.items()} and got["c"] == got["d"] == got["e"] == 0


def test_counted_before(spark):
    lists = spark.createDataFrame([("p", 1, "x"), ("p", 1, "y"), ("p", 3, "a"), ("q", 2, "b")], "k string, n int, id string")
    asked = spark.createDataFrame([("p", 1, "y", 7), ("p", 0, "y", 8), ("p", 9, "a", 9), ("r", 1, "x", 6), ("p", 1, "y", 7)], "k string, n int, id string, note int")
    assert sorted((r.note, r.before) for r in ev.counted_before(asked, lists, ["k"], ["n", "id"]).collect()) == [(6, 0), (7, 1), (7, 1), (8, 0), (9, 3)]


def test_inversions(spark):
    r = spark.createDataFrame([("q", 1, 0.2), ("q", 2, None), ("q", 3, 0.9), ("q", 4, 0.5), ("z", 1, 0.4)], "case string, rank int, accessibility double")
    got = {x.case: x for x in ev.ordering_inversions(spark.createDataFrame([("q",), ("z",), ("none",)], "case string"), r).collect()}
    assert (got["q"].n, got["q"].inversions, got["q"].top_mean, got["q"].monotone) == (3, 2, pytest.approx(0.55), False)
    assert (got["none"].inversions, got["none"].top_mean, got["none"].monotone) == (0, None, True)


def test_candidate_positions_equal_a_full_list(spark):
    every = [f"c{i}" for i in range(9)]
    scored = {"c2": ["c7", "c0", "c5"], "c4": []}
    p = spark.createDataFrame([(s, d, i + 1) for s, x in scored.items() for i, d in enumerate(x)], "src string, dst string, rank int")
    pairs = spark.createDataFrame([(s, d) for s in scored for d in every], "src string, dst string")
    got = {(r.src, r.dst): r["rank"] for r in ev.candidate_positions(pairs, p, spark.createDataFrame([(x,) for x in every], "dst string")).collect()}
    for s, x in scored.items():
        full = x + [d for d in every if d not in x and d != s] + [s]
        assert {d: i + 1 for i, d in enumerate(full)} == {d: got[s, d] for d in every}


def test_source_ranking_ties_go_to_the_smaller_target(spark):
    rows = [("j", "m", 0.7, 1), ("j", "k", 0.7, 0), ("j", "z", 0.1, 0), ("o", "r", 0.2, 1), ("o", "q", 0.3, 0), ("o", "p", 0.4, 0), ("u", "v", 1.0, 0)]
    m = ev.source_ranking_metrics(spark.createDataFrame(rows, "src string, dst string, score double, label int")).first()
    assert (m.sources, m.hits_1, m.hits_3, m.mrr) == (2, 0.0, 1.0, pytest.approx((1 / 2 + 1 / 3) / 2))


def test_auc_of_ties_and_order(spark):
    rows = [(1, 0.9, 1), (1, 0.8, 0), (1, 0.8, 1), (1, 0.1, 0), (2, 0.5, 1)]
    got = {r.k: r for r in ev.auc(spark.createDataFrame(rows, "k int, score double, label int"), ["k"]).collect()}
    assert got[1].auc == pytest.approx(0.875) and got[1].ap == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert got[2].auc is None


def test_fusion(spark):
    p = spark.createDataFrame([(9, f"m{i}", i) for i in (1, 2, 3)], "query_id long, id string, rank int")
    s = spark.createDataFrame([(9, "m2", 1), (9, "n1", 2), (9, "n2", 3), (9, "n3", 4)], "query_id long, id string, rank int")
    assert [r.id for r in sc.head_fusion(p, s, 2, 2).orderBy("rank").collect()] == ["m1", "m2", "n1", "n2", "m3", "n3"]
    both = p.withColumn("list", F.lit("one")).unionByName(s.withColumn("list", F.lit("two")))
    first = sc.rrf(both).orderBy("rank").first()
    assert (first.id, first.sources) == ("m2", "one,two")
    assert {r.id: r.score for r in sc.weighted_rrf(both, {"one": 0.25, "two": 0.75}).collect()}["m2"] == pytest.approx(0.25 / 62 + 0.75 / 61)
    with pytest.raises(ValueError):
        sc.weighted_rrf(both, {"one": 0.5, "two": 0.6})


def test_predictions_fill_up_and_do_not_vote(spark):
    lists = spark.createDataFrame([(1, "vector", "x", 1), (1, "skill", "y", 1), (1, "skill", "x", 2)], "query_id long, list string, id string, rank int")
    kinds = spark.createDataFrame([(1, "y", "direct_transition")], "query_id long, id string, evidence_type string")
    lp = spark.createDataFrame([(1, "z", 1), (1, "y", 2), (1, "x", 3), (2, "w", 1)], "query_id long, id string, rank int")
    got = [tuple(r) for r in sc.hybrid(lists, kinds, lp).orderBy("query_id", "rank").collect()]
    assert [(r[0], r[1], r[3], r[4]) for r in got] == [(1, "x", "predicted,skill,vector", "predicted_transition"), (1, "y", "predicted,skill", "direct_transition"), (1, "z", "predicted", "predicted_transition"), (2, "w", "predicted", "predicted_transition")]
    assert got[2][2] == 0.0 and got[3][2] == pytest.approx(1 / 61, abs=1e-9)


def test_order_by_gap(spark):
    rows = [("q", "a", "t", None, "direct_transition", 0.9, 5, 0.5), ("q", "b", "t", 0.4, None, None, None, 0.1), ("q", "c", "t", 0.4, "neighbour_transition", 0.1, 0, 0.1), ("q", "d", "s", 0.4, None, None, None, 0.1), ("n", "e", "t", None, None, None, None, 0.2), ("n", "f", "t", None, "direct_transition", 0.3, 1, 0.1)]
    got = sc.rank_by_gap(spark.createDataFrame(rows, "query_id string, id string, title string, accessibility double, evidence_type string, strength double, count long, score double"))
    assert [r.id for r in got.orderBy("query_id", "place").collect()] == ["f", "e", "c", "d", "b", "a"]


def test_path_skills_are_taken_while_a_role_has_room(spark):
    need = spark.createDataFrame([("r1", "s1"), ("r2", "s1"), ("r1", "s2"), ("r1", "s3"), ("r2", "s4")], "role string, skill string")
    got = sc.path_skills(spark.createDataFrame([(1, "r1"), (1, "r2")], "query_id long, role string"), need, 2).collect()
    assert sorted((r.skill, r.n) for r in got) == [("s1", 2), ("s2", 1), ("s4", 1)]


def test_gaps_are_null_without_evidence(spark):
    need = spark.createDataFrame([("r", "x", "own"), ("r", "y", "own")], "role string, skill string, status string")
    idf = spark.createDataFrame([("x", 3.0)], "dst string, idf double")
    t = spark.createDataFrame([(1, "r"), (2, "r")], "query_id long, role string")
    got = {r.query_id: r for r in sc.gaps(t, need, spark.createDataFrame([(1, "x")], "query_id long, skill string"), idf).collect()}
    assert (got[1].accessibility, got[1].qualification) == (0.75, 0.75)
    assert (got[2].accessibility, got[2].qualification) == (None, 0.0)


def test_effort_renormalises_over_known_parts(spark):
    rows = [(0.5, None, 1.0), (None, None, None)]
    got = sc.effort(spark.createDataFrame(rows, "gap double, domain double, other double"), {"gap": 0.35, "domain": 0.15, "other": 0.25}).collect()
    assert got[0].effort == pytest.approx((0.35 * 0.5 + 0.25) / 0.6) and got[1].effort is None


def test_pair_features(spark):
    rows = [("a", "x", 2, 1.0), ("a", "y", 3, 2.0), ("b", "x", 2, 1.0)]
    got = {(r.src, r.dst): r for r in sc.pair_features(spark.createDataFrame(rows, "role string, skill string, degree int, idf double")).collect()}
    r = got["a", "b"]
    assert (r.cn, r.jaccard, r.aa, r.ra, r.pa, r.idf_overlap) == (1, 0.5, pytest.approx(1 / math.log(2)), 0.5, 2, 1.0)


def test_uuid5_equals_python(spark):
    got = spark.createDataFrame([("graph::a",), ("é",)], "n string").select("n", g.uuid5(F.col("n")).alias("u")).collect()
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_DNS, r.n)) for r in got)


def test_idf_counts_edges(spark):
    e = spark.createDataFrame([(f"r{i}", s) for s, n in (("saw", 4), ("axe", 2), ("awl", 1)) for i in range(n)], "src string, dst string").withColumn("relation", F.lit("REQUIRES"))
    assert {r.dst: r.idf for r in g.idf(e, spark.createDataFrame([(4,)], "roles long")).collect()} == {"saw": 0.0, "axe": pytest.approx(math.log(2)), "awl": pytest.approx(math.log(4))}


def test_labels_are_folded_beyond_ascii(spark):
    rows = [("  Straße-Bau ", "strasse bau", "strasse-bau"), ("\uff26\uff35LL \ufb01t", "full fit", "full-fit"), ("É_a!", "é_a", "a"), ("--", "", "unknown"), (None, None, "unknown")]
    df = spark.createDataFrame(rows, "x string, label string, slug string")
    assert all((r.a, r.b) == (r.label, r.slug) for r in df.select(g.normalize_label(F.col("x")).alias("a"), g.slug(F.col("x")).alias("b"), "label", "slug").collect())


def test_quality_repair_names_the_first_reason(spark):
    nodes = spark.createDataFrame([("r", "role", "onet", " Role  one ", "PhD", 3, None), ("t", "role", "esco", "Two", None, None, None), ("s", "skill", "esco", "Skill", None, None, None), ("x", "odd", "esco", "X", None, None, None), ("lone", "skill", "esco", "Lone", None, None, None)], "id string, type string, source string, title string, typical_education_level string, job_zone int, job_zone_title string")
    edges = spark.createDataFrame(
        [("r", "s", "REQUIRES", "onet", None, 4.0, None, None, None), ("t", "s", "requires", "esco", "optional", None, None, None, None), ("t", "s", "REQUIRES", "esco", "essential", None, None, None, None), ("t", "x", "REQUIRES", "esco", None, None, None, None, None), ("t", "t", "SIMILAR_TO", "esco", None, None, None, None, None),
         ("r", "t", "TRANSITIONS_TO", "trajectory", None, None, 5, 0.5, "test"), ("r", "t", "TRANSITIONS_TO", "trajectory", None, None, 5, 1.5, "train")],
        "src string, dst string, relation string, source string, requirement_level string, importance double, count long, probability double, split string",
    ).withColumn("similarity", F.lit(None).cast("double")).withColumn("level_score", F.lit(None).cast("double")).withColumn("source_total", F.lit(None).cast("long"))
    n, e, report = g.improve(nodes, edges, tr.is_training())
    got = report.first()
    assert (got.removed_invalid_nodes, got.removed_invalid_edges, got.removed_self_loops, got.removed_held_out_transitions, got.removed_duplicate_edges, got.removed_isolates) == (1, 2, 1, 1, 1, 1)
    assert {r.id for r in n.collect()} == {"r", "t", "s", "derived:qualification:phd", "derived:job-zone:3"}
    assert [r.requirement_level for r in e.filter("src = 't' and dst = 's'").collect()] == ["essential"]


def test_prune_and_reach(spark):
    n = spark.createDataFrame([("r", "role"), ("t", "role"), ("x", "skill"), ("y", "skill"), ("z", "skill")], "id string, type string")
    e = spark.createDataFrame([("r", s, "REQUIRES") for s in "xyz"] + [("t", "x", "REQUIRES")], "src string, dst string, relation string")
    nodes, edges = g.prune(n, e, 3)
    assert {r.id for r in nodes.collect()} == {"r", "x", "y", "z"} and edges.count() == 3
    got = g.reach(e, spark.createDataFrame([(1, "t")], "query_id int, id string"), 2).collect()
    assert {(r.id, r.hops) for r in got} == {("t", 0), ("x", 1), ("r", 2)}


def test_texts(spark):
    skills = spark.createDataFrame([("s1", "Machine Learning (basics)"), ("s2", "R"), ("s3", "Go"), ("s4", "machine learning")], "id string, title string")
    aliases = x.skill_aliases(skills)
    assert sorted(map(tuple, aliases.collect())) == [("machine learning", "s1"), ("machine learning", "s4"), ("machine learning basics", "s1"), ("ml", "s4"), ("r", "s2")]
    p = spark.createDataFrame([(1, "Advanced ML"), (1, "go"), (2, " "), (2, "MACHINE  learning")], "query_id long, phrase string")
    assert sorted((r.phrase, r.alias, r.ids) for r in x.match_phrases(p, aliases).collect()) == [("Advanced ML", "ml", ["s4"]), ("MACHINE  learning", "machine learning", ["s1", "s4"]), ("go", None, None)]
    said = {"I know r and sql": True, "I do not know r": False, "I want to learn r": False, "R, sql": True, "I know sql but want r": False, "a b c d e f g h i j k r": False, "I want to move, I use r": True}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "query_id long, text string")
    owns = {r.query_id for r in ph.owned_phrases(rows, aliases.select(F.col("alias").alias("phrase")), ["query_id"]).filter("phrase = 'r' and owned").collect()}
    assert owns == {i for i, t in enumerate(said) if said[t]}
    found = x.owned_mentions(spark.createDataFrame([(7, "I know machine learning. I want to learn R.")], "query_id long, text string"), aliases).collect()
    assert [(r.alias, r.owned) for r in found] == [("machine learning", True)]
    answer = spark.createDataFrame([(1, 'Try **Data Engineer** or "site lead". Python helps; with Java/Rust you learn my graph theory.'), (2, None)], "query_id long, text string")
    assert [r.entity for r in x.extract_entities(answer).orderBy("n").collect()] == ["Data Engineer", "site lead", "Java", "Rust", "graph theory"]


def test_fuzzy_names_equal_a_search_of_all(spark):
    from difflib import SequenceMatcher

    titles = ["warehouse operator", "warehouse operators", "field biologist", "marine biologist", "chief accountant", "dance teacher", "dance teachers aide"]
    asked = ["field biologst", "FIELD BIOLOGIST", "chef accountant", "dance teachr", "warehouse operatr", "astronaut", "marine biologists"]
    got = {r.phrase: r.id for r in x.resolve_roles(spark.createDataFrame([(a,) for a in asked], "phrase string"), spark.createDataFrame([(t, t) for t in titles], "id string, title string")).collect()}
    for a in asked:
        ranked = sorted(((SequenceMatcher(None, a.lower(), t).ratio(), t) for t in titles), reverse=True)
        want = a.lower() if a.lower() in titles else ranked[0][1] if ranked[0][0] >= 0.9 and ranked[0][0] - ranked[1][0] >= 0.03 else None
        assert got[a] == want, a


def test_faithfulness(spark):
    nodes = spark.createDataFrame([("a", "role", "Night Guard"), ("b", "role", "Day Guard"), ("c", "skill", "Judo")], "id string, type string, title string")
    edges = spark.createDataFrame([("a", "c")], "src string, dst string")
    texts = spark.createDataFrame([(1, "A **Night Guard** who knows **Judo**, a **Day Guard** and **Fencing**."), (2, "nothing here")], "query_id long, text string")
    got = {r.query_id: r for r in x.faithfulness(texts, spark.createDataFrame([(1, "a"), (2, "a")], "query_id long, id string"), nodes, edges).collect()}
    assert (got[1].entities, got[1].matched, got[1].reachable, got[1].score) == (4, 3, 2, 0.5) and got[2].score == 1.0


def test_faithfulness_walks_the_whole_graph(spark, tmp_path):
    from waymark.plans import text_queries

    def put(name, columns, *rows):
        spark.createDataFrame(rows, columns).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))

    # optional skills of brands, a supplier that needs both skills, and a ring that the first brand doesn't need itself
    put("part", "p_partkey long, p_name string, p_brand string, p_size int", (1, "old gizmo", "Brand#1", 10), (2, "hot ring", "Brand#2", 10), (3, "hot ring", "Brand#1", 10))
    put("supplier", "s_suppkey long, s_name string, s_nationkey int", (5, "Five", 0))
    put("lineitem", "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double", (1, 1, 1, 5, 1.0, 0.0), (1, 2, 2, 5, 1.0, 0.0))
    put("orders", "o_orderkey long, o_custkey long, o_orderdate timestamp", (1, 1, datetime.datetime(1995, 1, 1)))
    put("nation", "n_nationkey int, n_name string", (0, "N"))
    put("embeddings", "vec_id long, embedding array<float>", (1, [1.0, 0.0]), (2, [0.0, 1.0]), (105, [-1.0, -1.0]))
    got = text_queries.faithfulness(spark, str(tmp_path)).collect()
    # the second brand is four steps from the first
    assert sorted((r.query_id, r.entities, r.matched, r.reachable, r.score) for r in got) == [(1, 4, 3, 2, 0.5), (2, 4, 2, 2, 0.5), (3, 4, 2, 2, 0.5)]


def test_pairs_that_have_met_are_not_walked_for(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(g, "stored", lambda df, label: steps.append(label) or df.localCheckpoint())
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    starts = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "query_id long, id string")
    ends = spark.createDataFrame([(1, "b"), (2, "a"), (2, "b"), (3, "a"), (4, "d"), (1, None)], "query_id long, id string")
    got = sorted(map(tuple, g.reached(edges, starts, ends, 9).collect()))
    assert got == [(1, "b"), (2, "a"), (2, "b")] and "front" not in steps


def test_what_texts_name_is_worked_out_once(spark):
    nodes = spark.createDataFrame([("a", "role", "Night Guard"), ("c", "skill", "Judo")], "id string, type string, title string")
    texts = spark.createDataFrame([(1, "A **Night Guard** who knows **Judo**.")], "query_id long, text string")
    got = x.faithfulness(texts, spark.createDataFrame([(1, "a")], "query_id long, id string"), nodes, spark.createDataFrame([("a", "c")], "src string, dst string"))
    assert "EvalPython" not in got._jdf.queryExecution().executedPlan().toString() and got.first().score == 1.0


def test_edges_are_judged_once(spark):
    nodes = spark.createDataFrame([("r", "role", "onet", "R", None, 1, None), ("s", "skill", "esco", "S", None, None, None)], "id string, type string, source string, title string, typical_education_level string, job_zone int, job_zone_title string")
    edges = spark.createDataFrame([("r", "s", "REQUIRES", "esco", "essential", None, None, None, "train")] * 2, "src string, dst string, relation string, source string, requirement_level string, importance double, count long, probability double, split string")
    edges = edges.withColumn("similarity", F.lit(None).cast("double")).withColumn("level_score", F.lit(None).cast("double")).withColumn("source_total", F.lit(None).cast("long"))
    for df, rows in zip(g.improve(nodes, edges, tr.is_training()), (3, 2, 1), strict=True):
        assert "Window" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == rows


def test_stores_refuse_what_is_wrong(spark, tmp_path):
    one = spark.createDataFrame([("p", 1)], "person string, ord int")
    for name in ("my_train", "my_validation", "test_a", "test_b"):
        one.write.option("header", True).csv(str(tmp_path / name))
    files = lambda *names: spark.createDataFrame([(str(tmp_path / n),) for n in names], "path string")
    ok = st.split_files(spark, files("my_train", "my_validation", "test_a"), "person string, ord int", ("person", "ord"))
    assert {r.split for r in ok.collect()} == {"train", "validation", "test"}
    with pytest.raises(ValueError, match="2 tables"):
        st.split_files(spark, files("my_train", "my_validation", "test_a", "test_b"), "person string, ord int", ("person",))
    with pytest.raises(ValueError, match="lacks label"):
        st.split_files(spark, files("my_train", "my_validation", "test_a"), "person string, ord int", ("person", "label"))
    with pytest.raises(Exception, match="several sizes"):
        st.sink_vectors(spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "id string, vec array<double>"), str(tmp_path / "points"))
    with pytest.raises(Exception, match="unknown type"):
        st.sink_graph(spark.createDataFrame([("a", "odd")], "id string, type string"), spark.createDataFrame([], "src string, dst string, relation string, source string"), str(tmp_path / "graph"))


def test_late_labels_make_a_position_ambiguous(spark, tmp_path):
    from waymark.streaming.incremental import run_available

    schema = "person long, ord long, label string"
    for rows in ([(1, 0, "a"), (1, 1, "b")], [(1, 1, "c"), (1, 2, "d"), (1, 3, "e")], [(1, 4, "f"), (1, 5, None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = run_available(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "state"), 1)
    assert sorted(map(tuple, got.collect())) == [(1, "d", "e"), (1, "e", "f")]


def test_incremental_pairs_equal_batch(spark, tmp_path):
    from waymark.operators import trajectories as t
    from waymark.streaming.incremental import run_available

    rows = [(p, o, "abc"[(p * 7 + o * o) % 3]) for p in range(6) for o in range(20)]
    schema = "person long, ord long, label string"
    ends = [(p, 20, None) for p in range(6)]
    for low in (0, 7, 14):
        spark.createDataFrame([r for r in rows + ends if low <= r[1] < low + 7], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = run_available(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "state"), 1)
    want = t.transitions(spark.createDataFrame(rows, schema)).select("person", "src", "dst")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def _planned(df):
    return df._jdf.queryExecution().toString()


def test_gaps_keep_a_target_one_row(spark):
    t = spark.createDataFrame([(1, "r1"), (1, "r2"), (2, "r1"), (1, "r1")], "query_id long, role string")
    need = spark.createDataFrame([("r1", "x"), ("r1", "y"), ("r2", "z"), ("r3", "x")], "role string, skill string")
    own = spark.createDataFrame([(1, "x"), (1, "q")], "query_id long, skill string")
    idf = spark.createDataFrame([("x", 3.0), ("z", 2.0)], "dst string, idf double")
    out = sc.gaps(t, need, own, idf)
    assert sorted(map(tuple, out.collect())) == [(1, "r1", 2, 1, 0.75, 0.75), (1, "r2", 1, 0, 0.0, 0.0), (2, "r1", 2, 0, None, 0.0)]
    assert "hashpartitioning(query_id" in _planned(out) and "query_id#" in _planned(out)
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, skill", _planned(out))


def test_path_skills_are_chosen_once_for_each_set_of_roles(spark):
    need = spark.createDataFrame([("r1", f"s{i}") for i in range(4)] + [("r2", "s1"), ("r2", "s9")], "role string, skill string")
    shown = spark.createDataFrame([(q, r) for q in range(40) for r in (("r1", "r2") if q % 2 else ("r1",))], "query_id long, role string")
    out = sc.path_skills(shown, need, 2)
    got = sorted((r.query_id, r.skill, r.n) for r in out.collect())
    odd, even = [("s0", 1), ("s1", 2), ("s9", 1)], [("s0", 1), ("s1", 1)]
    assert got == [(q, *x) for q in range(40) for x in (odd if q % 2 else even)]
    assert "FlatMapGroups" not in _planned(out)


def test_surroundings_of_aligned_anchors_come_once_without_a_shuffle_of_triples(spark):
    nodes = spark.createDataFrame([("a", "esco", "A"), ("b", "onet", "B"), ("c", "esco", "C"), ("d", "esco", "D")], "id string, source string, title string")
    none = (None, None, None, None, None)
    rows = [("a", "b", "SIMILAR_TO", *none), ("b", "a", "SIMILAR_TO", *none), ("d", "a", "SIMILAR_TO", *none), ("a", "s", "REQUIRES", "essential", *none[1:]), ("b", "s", "REQUIRES", None, 4.0, *none[2:])]
    rows.append(("a", "c", "TRANSITIONS_TO", None, None, "train", 0.5, 5))
    edges = spark.createDataFrame(rows, "src string, dst string, relation string, requirement_level string, importance double, split string, probability double, count long")
    anchors = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "query_id long, id string")
    out = g.traverse(anchors, nodes, edges, F.col("relation") == "TRANSITIONS_TO")
    of_a = [("a", "REQUIRES", "s"), ("a", "SIMILAR_TO", "b"), ("a", "TRANSITIONS_TO", "c"), ("b", "SIMILAR_TO", "a"), ("d", "SIMILAR_TO", "a")]
    want = [(1, *x) for x in [*of_a, ("b", "REQUIRES", "s")]] + [(2, *x) for x in of_a]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, src#\d+, relation", _planned(out))
    told = g.evidence_triples(out, spark.createDataFrame([(1, "a", "c", "direct_transition"), (2, "a", "d", "predicted_transition")], "query_id long, current string, id string, evidence_type string"))
    assert sorted(map(tuple, told.collect())) == sorted([*want, (2, "a", "PREDICTED_TRANSITION", "d")])


def test_traces_are_made_by_one_join_and_never_dealt_anew(spark):
    nodes = spark.createDataFrame([("a", "esco", "A"), ("b", "onet", "B"), ("c", "esco", "C")], "id string, source string, title string")
    none = (None, None, None, None, None)
    rows = [("a", "b", "SIMILAR_TO", *none), ("b", "a", "SIMILAR_TO", *none), ("x", "a", "SIMILAR_TO", *none), ("a", "c", "TRANSITIONS_TO", None, None, "train", 0.5, 5)]
    edges = spark.createDataFrame(rows, "src string, dst string, relation string, requirement_level string, importance double, split string, probability double, count long")
    c = spark.createDataFrame([(1, "a", "b", None), (1, "a", "c", "direct_transition"), (2, "c", "a", "direct_transition"), (3, "a", "x", "predicted_transition")], "query_id long, current string, id string, evidence_type string")
    anchors = c.select("query_id", "id").unionByName(c.select("query_id", F.col("current").alias("id"))).distinct()
    found = g.surroundings(nodes.select("id"), nodes, edges, F.col("relation") == "TRANSITIONS_TO").localCheckpoint()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = g.around(anchors, found)
        plan = _planned(out).split("== Physical Plan ==")[1]
        assert plan.count("SortMergeJoin") == 1 and not re.search(r"hashpartitioning\(query_id#\d+L?, src", plan)
        told = g.evidence_triples(out, c, found)
        assert _planned(told).split("== Physical Plan ==")[1].count("SortMergeJoin") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    of_a = [("a", "SIMILAR_TO", "b"), ("a", "TRANSITIONS_TO", "c"), ("b", "SIMILAR_TO", "a"), ("x", "SIMILAR_TO", "a")]
    want = [(1, *x) for x in of_a] + [(2, *x) for x in of_a] + [(2, "c", "TRANSITIONS_TO", "a")] + [(3, *x) for x in of_a] + [(3, "a", "PREDICTED_TRANSITION", "x")]
    assert sorted(map(tuple, told.collect())) == sorted(want) == sorted(map(tuple, g.evidence_triples(out, c).collect()))


def test_triples_of_one_anchor_lie_together(spark):
    found = spark.createDataFrame([(a, a, "REQUIRES", f"s{i}", False, False) for a in "abc" for i in range(4)], "anchor string, src string, relation string, dst string, into boolean, again boolean")
    anchors = spark.createDataFrame([(q, a) for q in range(200) for a in "abc" if q % 7 or a != "b"], "query_id long, id string")
    parts = g.around(anchors, found).groupBy(F.spark_partition_id().alias("p")).agg(F.collect_list("src").alias("src")).collect()
    assert sum(len(p.src) for p in parts) == anchors.count() * 4
    for p in parts:
        assert sum(x != y for x, y in zip(p.src, p.src[1:], strict=False)) < 3


def test_similar_names_meet_by_subsequences_as_by_pieces(spark, monkeypatch):
    names = [f"supplier {i:06d}" for i in range(300)]
    roles = spark.createDataFrame([(f"r{i}", t) for i, t in enumerate(names)], "id string, title string")
    asked = spark.createDataFrame([(t,) for i, n in enumerate(names[::7]) for t in [(n + "x", n[:3] + n[4:], "zz" + n[2:], n.upper())[i % 4]]], "phrase string")
    keys, aliases = asked.select(x.normalize_label(F.col("phrase")).alias("key")), roles.select(F.col("title").alias("alias"))
    met = {tuple(r) for r in x._similar(keys, aliases, 0.9).collect()}
    assert len(met) < keys.count() * 60
    ratio = lambda a, z: x.SequenceMatcher(None, a, z).ratio()
    assert {(k.key, a) for k in keys.collect() for a in names if ratio(k.key, a) >= 0.9} <= met
    got = sorted(map(tuple, x.resolve_roles(asked, roles).collect()))
    monkeypatch.setattr(x, "SUBSEQUENCES", 0)
    assert got == sorted(map(tuple, x.resolve_roles(asked, roles).collect())) and sum(r[1] is not None for r in got) > 20


def test_entities_stay_with_their_text(spark):
    rows = spark.createDataFrame([(1, "**Data Mining** and Java/Rust, data mining"), (1, "**Data Mining** and Java/Rust, data mining"), (1, "**Go Lang**"), (2, None), (3, "")], "query_id long, text string")
    out = x.extract_entities(rows)
    assert sorted(map(tuple, out.collect())) == [(1, 0, "Data Mining"), (1, 0, "Go Lang"), (1, 1, "Java"), (1, 2, "Rust")]
    plan = _planned(out)
    assert "Window" not in plan.split("== Optimized Logical Plan ==")[1] and "min(struct" not in plan
