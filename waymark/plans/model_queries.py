"""Registered queries over vectors, transition models and their evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import scoring as sc
from ..operators import transitions as tr
from ..operators import trajectories as t
from ..operators import vectors as v
from ..sources import bridge as b
from ..sources.shared import staged
from .trajectory_queries import CHAIN, _PREFIX, _SECOND, kept, train_counts, train_pairs

K = 5


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@staged
def role_vectors(s: SparkSession, d: str) -> DataFrame:
    return v.normalised(b.vectors(s, d))


def brand_vectors(s: SparkSession, d: str) -> DataFrame:
    return role_vectors(s, d).filter("id like 'a:%'").withColumn("id", F.substring("id", 3, 100))


def load_vectors(s, d):
    """Vectors asked for: all roles; found: those of roles. Those of suppliers whose key 7 divides are made unusable in
    five ways on purpose."""
    ids = b.roles_a(s, d).select("id").unionByName(b.roles_b(s, d).select("id"))
    n = F.when(F.col("id").startswith("b:"), F.substring("id", 3, 20).cast("long")).otherwise(1)
    nan, zero = F.transform("vec", lambda x: F.lit(float("nan")).cast("float")), F.transform("vec", lambda x: F.lit(0).cast("float"))
    vec = F.when(n % 35 == 0, nan).when(n % 35 == 7, zero).when(n % 35 == 14, F.slice("vec", 1, 3)).when(n % 35 == 21, F.array().cast("array<float>")).when(n % 35 == 28, F.lit(None)).otherwise(F.col("vec"))
    dim = 64
    return v.load_report(ids, b.vectors(s, d).withColumn("vec", vec), dim)


def vector_norms(s, d):
    return b.vectors(s, d).select("id", F.round(v.norm(F.col("vec")), 6).alias("norm"), F.size("vec").alias("dim"))


def knn_join(s, d):
    return r6(v.nearest(role_vectors(s, d).filter("id like 'a:%'"), role_vectors(s, d), K), "similarity")


def vector_search(s, d):
    """The three nearest roles of each supplier's vector."""
    q = role_vectors(s, d).filter("id like 'b:%'")
    return r6(v.nearest(q, role_vectors(s, d).filter("id like 'a:%'"), 3).withColumn("score", F.col("similarity")), "score").select("id", F.col("nbr").alias("role"), "score", "rank")


def similarity_join(s, d):
    vec = role_vectors(s, d)
    return r6(v.similar_pairs(vec.filter("id like 'a:%'"), vec.filter("id like 'b:%'"), 0.15), "similarity")


#: 21 thresholds in steps of two hundredths.
THRESHOLDS = [round(0.02 * i, 2) for i in range(21)]


def threshold_sweep(s, d):
    vec = role_vectors(s, d)
    group = b.roles_a(s, d).select("id", F.substring("isco_group", 1, 2).alias("group")).unionByName(b.roles_b(s, d).select("id", F.col("isco_group").alias("group")))
    named = vec.join(group, "id")
    return r6(v.threshold_sweep(named.filter("id like 'a:%'"), named.filter("id like 'b:%'"), THRESHOLDS), "precision", "recall", "f1")


@staged
def near_brands(s, d):
    """Each brand's ten nearest."""
    q = brand_vectors(s, d)
    return v.nearest(q, q, 10)


def brand_neighbours(s, d, k=K):
    return near_brands(s, d).filter(F.col("rank") <= k)


def transition_walk(s, d):
    return r6(tr.walks(train_counts(s, d, 5), 3), "p")


def blend_walks(s, d):
    return r6(tr.blend(tr.walks(train_counts(s, d, 5), 3), {1: 0.6, 2: 0.3, 3: 0.1}), "score")


def softmax_weights(s, d):
    w = Window.partitionBy("id")
    e = brand_neighbours(s, d).withColumn("e", F.exp((F.col("similarity") - F.max("similarity").over(w)) / 0.06))
    return e.select("id", "nbr", F.round(F.col("e") / F.sum("e").over(w), 6).alias("weight"))


@staged
def _smoothed(s, d):
    return tr.smooth(train_counts(s, d, 5), brand_neighbours(s, d))


def smoothed(s, d, alpha=None):
    return _smoothed(s, d) if alpha is None else tr.smooth(train_counts(s, d, 5), brand_neighbours(s, d), alpha=alpha)


def smooth_transitions(s, d):
    return r6(smoothed(s, d), "score", "direct", "neighbour")


def smooth_empirical_bayes(s, d):
    return r6(smoothed(s, d, 10.0), "score", "direct", "neighbour")


def second_order_scores(s, d):
    got = t.second_order(t.prefixes(kept(s, d).filter("split = 'train'")))
    ctx = got.groupBy("previous", "current", "dst").count().withColumn("context_total", F.sum("count").over(Window.partitionBy("previous", "current")))
    return r6(tr.second_order(train_counts(s, d, 5), ctx), "score")


def direct_predictions(s, d, support=1):
    return ev.ranked(train_counts(s, d, support), ["src"], F.desc("probability"), F.desc("count"), F.col("dst"))


@staged
def smooth_full(s, d):
    """Smoothed transitions with all their evidence, ranked."""
    return ev.ranked(smoothed(s, d).withColumn("score", F.round("score", 9)), ["src"], F.desc("score"), F.col("dst"))


def smooth_predictions(s, d):
    return smooth_full(s, d)


@staged
def held_pairs(s, d):
    """(person, split, src, dst): valid transitions of people who are held out."""
    return t.transitions(b.career_steps(s, d).filter("split <> 'train'"), ("split",)).select("person", "split", "src", "dst")


def held_out(s, d, split):
    return held_pairs(s, d).filter(F.col("split") == split).groupBy("src", "dst").count()


def evidence_predictions(s, d):
    """Destinations by the best of the neighbours' probabilities, the fifty first of each source."""
    n = brand_neighbours(s, d, 10).join(train_counts(s, d, 5).select(F.col("src").alias("nbr"), "dst", "probability"), "nbr").filter("dst <> id")
    best = n.groupBy(F.col("id").alias("src"), "dst").agg(F.max(F.round("probability", 9)).alias("score"))
    return ev.ranked(best, ["src"], F.desc("score"), F.col("dst")).filter("rank <= 50")


def combined_predictions(s, d):
    """Of each source the first list that is there: smoothed, direct, evidence."""
    lists = [f.select(F.col("src").alias("query_id"), F.lit(i).alias("priority"), "dst", "rank") for i, f in enumerate((smooth_predictions(s, d), direct_predictions(s, d, 5), evidence_predictions(s, d)))]
    return sc.priority_combine(lists[0].unionByName(lists[1]).unionByName(lists[2])).select(F.col("query_id").alias("src"), "dst", "rank")


def heldout_metrics(s, d):
    m = ev.heldout_metrics(direct_predictions(s, d), held_out(s, d, "test"))
    return r6(m, *[c for c in m.columns if c != "observations"])


def held_counts(s, d):
    """(split, src, dst, count) of both splits that are held out."""
    return held_pairs(s, d).groupBy("split", "src", "dst").count()


def strategy_comparison(s, d):
    """Four ways to rank side by side, with what each adds to direct counts; methods and splits are columns of one pass."""
    methods = {"direct": direct_predictions(s, d, 5), "smoothed": smooth_predictions(s, d), "evidence": evidence_predictions(s, d), "combined": combined_predictions(s, d)}
    lists = None
    for name, p in methods.items():
        one = p.select(F.lit(name).alias("method"), "src", "dst", "rank")
        lists = one if lists is None else lists.unionByName(one)
    every = s.createDataFrame([(m, x) for m in methods for x in ("validation", "test")], "method string, split string")
    names = ["mrr", "hits_5", "hits_10", "observation_coverage"]
    out = every.join(ev.metrics_by(lists, held_counts(s, d), ["method"], ("split",)), ["method", "split"], "left").select("method", "split", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in names])
    base = F.max(F.when(F.col("method") == "direct", F.col("mrr"))).over(Window.partitionBy("split"))
    return r6(out.withColumn("mrr_gain", F.col("mrr") - base), *names, "mrr_gain")


def acceptance_gate(s, d):
    a = ev.heldout_metrics(direct_predictions(s, d, 5), held_out(s, d, "test"), (5, 10)).select(*[F.col(c).alias(f"before_{n}") for c, n in (("mrr", "mrr"), ("hits_5", "hits_5"), ("hits_10", "hits_10"), ("observation_coverage", "coverage"))])
    z = ev.heldout_metrics(smooth_predictions(s, d), held_out(s, d, "test"), (5, 10)).select(*[F.col(c).alias(f"after_{n}") for c, n in (("mrr", "mrr"), ("hits_5", "hits_5"), ("hits_10", "hits_10"), ("observation_coverage", "coverage"))])
    return ev.acceptance(a.crossJoin(z))


def events(s, d, split="test"):
    return held_pairs(s, d).filter(F.col("split") == split).select("person", "src", F.col("dst").alias("target"))


def prefix_metrics(s, d):
    e = ev.event_values(events(s, d), direct_predictions(s, d))
    return r6(e.agg(F.count("*").alias("events"), F.avg("rr").alias("mrr"), F.avg("hit").alias("hits_10"), F.avg("ndcg").alias("ndcg_10"), F.avg(F.col("covered").cast("double")).alias("coverage")), "mrr", "hits_10", "ndcg_10", "coverage")


def person_bootstrap(s, d):
    return r6(ev.person_bootstrap(ev.event_values(events(s, d), direct_predictions(s, d)), "rr", 100), "mean", "low", "high")


def paired_bootstrap(s, d):
    """What smoothing adds to direct transitions on test events, with intervals over people drawn alike for both."""
    e = events(s, d)
    before, after = (ev.event_values(e, p) for p in (direct_predictions(s, d), smooth_predictions(s, d)))
    return r6(ev.paired_bootstrap(before, after, ("rr", "hit"), 100), "gain", "low", "high", "better")


def labelled_scores(s, d):
    pos = held_out(s, d, "test").select("src", "dst", F.lit(1).alias("label"))
    return smoothed(s, d).select("src", "dst", F.round("score", 9).alias("score")).join(pos, ["src", "dst"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def source_ranking_metrics(s, d):
    m = ev.source_ranking_metrics(labelled_scores(s, d))
    return r6(m, *[c for c in m.columns if c != "sources"])


def auc_ap(s, d):
    fold = t.stable_fold(F.col("src"), 3)
    return r6(ev.auc(labelled_scores(s, d).withColumn("fold", fold), ["fold"]), "auc", "ap")


def full_candidate_rank(s, d):
    """The place of each observed test destination among all roles."""
    return ev.candidate_positions(held_out(s, d, "test"), direct_predictions(s, d, 5), b.roles_a(s, d).select(F.col("title").alias("dst")))


def optimistic_rank(s, d):
    w = Window.partitionBy("src").orderBy(F.desc("count"))
    return train_counts(s, d).select("src", "dst", F.rank().over(w).alias("rank"))


def rank_without_sort(s, d):
    """The place of each observed test destination in its source's counts: one more than those that are better."""
    c = train_counts(s, d).select("src", "dst", (-F.col("count")).alias("worth"))
    own = held_out(s, d, "test").select("src", "dst").join(c, ["src", "dst"])
    return ev.counted_before(own, c, ["src"], ["worth", "dst"]).select("src", "dst", (F.col("before") + 1).cast("long").alias("rank"))


def seed_spread(s, d):
    """Mean, spread and extremes of validation metrics over runs that each leave one fold of people out of the counts, and
    the run that wins by (mrr, hits_5, hits_10)."""
    folds = 4
    pairs = train_pairs(s, d).withColumn("fold", t.stable_fold(F.col("person"), folds)).groupBy("src", "dst").agg(F.count("*").alias("all"), *[F.count_if(F.col("fold") == i).alias(f"n{i}") for i in range(folds)])
    out = None
    for i in range(folds):
        c = pairs.select("src", "dst", (F.col("all") - F.col(f"n{i}")).alias("count")).filter("count > 0")
        p = ev.ranked(c, ["src"], F.desc("count"), F.col("dst"))
        m = ev.heldout_metrics(p, held_out(s, d, "validation"), (5, 10)).select(F.lit(i).alias("run"), *[F.round(x, 9).alias(x) for x in ("mrr", "hits_5", "hits_10")])
        out = m if out is None else out.unionByName(m)
    win = out.agg(F.max(F.struct("mrr", "hits_5", "hits_10", -F.col("run")))[F.lit("col4")].alias("w")).select((-F.col("w")).alias("winner"))
    each = out.select("run", F.explode(F.map_from_arrays(F.array(*map(F.lit, ("mrr", "hits_5", "hits_10"))), F.array("mrr", "hits_5", "hits_10"))).alias("metric", "value"))
    spread = each.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("low"), F.max("value").alias("high"))
    return r6(spread.crossJoin(F.broadcast(win)), "mean", "std", "low", "high")


def band_thresholds(s, d):
    return r6(ev.band_thresholds(train_counts(s, d), "probability"), "low", "high")


def ordering_inversions(s, d):
    """Each source's smoothed list as a case, the popularity of its destinations as what should fall along it."""
    pop = t.transition_context(train_counts(s, d)).select("dst", "dest_count")
    r = smooth_predictions(s, d).join(pop, "dst", "left").select(F.col("src").alias("case"), "rank", F.col("dest_count").cast("double").alias("accessibility"))
    return r6(ev.ordering_inversions(b.roles_a(s, d).select(F.col("title").alias("case")), r), "top_mean")


# 63 configurations: neighbours, direct weight, temperature.
GRID = ((3, 5, 10), (0.25, 0.4, 0.5, 0.6, 0.75, 0.85, 0.91), (0.03, 0.06, 0.1))


def select_config(s, d):
    """All configurations by validation MRR, then Hits at 5, the simplest of equals first."""
    ks, weights, temperatures = GRID
    scored = tr.smooth_grid(train_counts(s, d, 5), brand_neighbours(s, d, 10), ks, weights, temperatures).withColumn("score", F.round("score", 9))
    keys = ["k", "direct_weight", "temperature"]
    ranked = ev.ranked(scored, [*keys, "src"], F.desc("score"), F.col("dst"))
    held = held_out(s, d, "validation").withColumn("total", F.sum("count").over(Window.partitionBy()))
    m = ranked.join(held, ["src", "dst"]).groupBy(*keys).agg((F.sum(F.col("count") / F.col("rank")) / F.max("total")).alias("mrr"), (F.sum(F.when(F.col("rank") <= 5, F.col("count")).otherwise(0)) / F.max("total")).alias("hits_5"))
    # a row a configuration: the window is over their number
    m = r6(m, "mrr", "hits_5")
    return m.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mrr"), F.desc("hits_5"), *keys)))


QUERIES = {f.__name__: f for f in (
    load_vectors, vector_norms, knn_join, vector_search, similarity_join, threshold_sweep, transition_walk, blend_walks, softmax_weights, smooth_transitions, smooth_empirical_bayes,
    second_order_scores, heldout_metrics, strategy_comparison, acceptance_gate, prefix_metrics, person_bootstrap, paired_bootstrap, source_ranking_metrics, auc_ap, full_candidate_rank, optimistic_rank,
    rank_without_sort, seed_spread, band_thresholds, ordering_inversions, select_config,
)}

_VEC = f"""{b.SQL_ROLES_A}, {b.SQL_ROLES_B}, {b.SQL_VECTORS}, unit as (
  select id, [cast(x as double) / n for x in vec] as vec from (select id, vec, sqrt(list_sum([cast(x as double) * cast(x as double) for x in vec])) as n from vectors)
), sims as (
  select p.id as id, q.id as nbr, round(list_inner_product(p.vec, q.vec), 9) as similarity from unit p, unit q where p.id <> q.id
)"""
_NEAR = f"""nearest as (
  select * from (select substr(id, 3) as id, substr(nbr, 3) as nbr, similarity, row_number() over (partition by id order by similarity desc, nbr) as rank from sims where id like 'a:%' and nbr like 'a:%') where rank <= {K}
), c5 as (select * from counts where count >= 5)"""
_SMOOTH = """known as (select * from nearest where nbr in (select src from c5)
), weighed as (select id, nbr, exp((similarity - max(similarity) over (partition by id)) / 0.06) as e from known
), w as (select id, nbr, e / sum(e) over (partition by id) as w from weighed
), prior as (select id as src, dst, sum(w * probability) as neighbour, count(*) as support from w join c5 on nbr = src where dst <> id group by id, dst
), mixed as (
  select src, dst, coalesce(c5.probability, 0) as direct, coalesce(neighbour, 0) as neighbour, coalesce(support, 0) as support, coalesce(count, 0) as count,
    src in (select src from c5) as hd, src in (select src from prior) as hp, max(source_total) over (partition by src) as total from c5 full join prior using (src, dst)
), smoothed as (
  select src, dst, case when hd and hp then {mix} when hd then direct else neighbour end as score, direct, neighbour, support, count,
    case when direct > 0 then 'direct_transition' else 'neighbour_transition' end as evidence from mixed
), smooth as (select * from smoothed where score > 0)"""
_MODEL = f"{CHAIN}, {_VEC}, {_NEAR}"
_S = _SMOOTH.format(mix="0.75 * direct + 0.25 * neighbour")
_HELD = "held as (select src, dst, count(*) as count from classified where reason = 'valid' and split = '{}' group by src, dst)"
_DIRECT = "direct as (select src, dst, row_number() over (partition by src order by probability desc, count desc, dst) as rank from counts where count >= {})"
_SMOOTH_RANK = "ranked as (select src, dst, row_number() over (partition by src order by round(score, 9) desc, dst) as rank from smooth)"


def metrics_sql(pred: str, held: str, ks: tuple[int, ...], tag: str = "") -> str:
    per = ", ".join(f"sum(case when rank <= {k} then count else 0 end) as h{k}, sum(case when rank <= {k} then count / log2(rank + 1) else 0 end) as dcg{k}, sum(case when ideal <= {k} then count / log2(ideal + 1) else 0 end) as idcg{k}" for k in ks)
    return f"""by_src{tag} as (
  select src, sum(count) as n, bool_or(src in (select src from {pred})) as covered, sum(coalesce(count / rank, 0)) as rr, sum(case when rank is not null then count else 0 end) as found, {per}
  from (select src, dst, count, row_number() over (partition by src order by count desc, dst) as ideal from {held}) left join {pred} using (src, dst) group by src)"""


def _metric_columns(ks: tuple[int, ...]) -> str:
    return ", ".join(
        f"round(sum(h{k}) / sum(n), 6) as hits_{k}, round(sum(h{k}) / sum(n) filter (covered), 6) as covered_only_hits_{k}, round(avg(h{k} / n), 6) as macro_hits_{k}, round(sum(dcg{k} / idcg{k} * n) / sum(n), 6) as ndcg_{k}, round(avg(dcg{k} / idcg{k}), 6) as macro_ndcg_{k}"
        for k in ks
    )


_SHORT = "round(sum(rr) / sum(n), 6) as mrr, round(sum(h5) / sum(n), 6) as hits_5, round(sum(h10) / sum(n), 6) as hits_10, round(coalesce(sum(n) filter (covered), 0) / sum(n), 6) as observation_coverage"
_SHORT_RAW = _SHORT.replace("round(", "(").replace(", 6)", ")")
_NEAR_10 = "nearest10 as (select * from (select substr(id, 3) as id, substr(nbr, 3) as nbr, similarity, row_number() over (partition by id order by similarity desc, nbr) as rank from sims where id like 'a:%' and nbr like 'a:%') where rank <= 10)"
_EVIDENCE = """evidence as (select * from (select id as src, dst, row_number() over (partition by id order by max(round(probability, 9)) desc, dst) as rank from nearest10 join c5 on src = nbr where dst <> id group by id, dst) where rank <= 50
), combined as (select src, dst, rank from ranked union all select src, dst, rank from direct where src not in (select src from ranked) union all select src, dst, rank from evidence where src not in (select src from ranked) and src not in (select src from direct))"""
_METHODS = {"direct": "direct", "smoothed": "ranked", "evidence": "evidence", "combined": "combined"}
_WALK = """w1 as (select src, dst, probability as p from counts where count >= 5 and src <> dst
), w2 as (select w1.src, c.dst, sum(p * c.probability) as p from w1 join counts c on w1.dst = c.src and c.count >= 5 where c.dst <> w1.src group by all
), w3 as (select w2.src, c.dst, sum(p * c.probability) as p from w2 join counts c on w2.dst = c.src and c.count >= 5 where c.dst <> w2.src group by all
), walk as (select *, 1 as step from w1 union all select *, 2 from w2 union all select *, 3 from w3)"""
_EVENTS = "events_ as (select person, src, dst from classified where reason = 'valid' and split = 'test')"
_VALUES = f"{_EVENTS}, {_DIRECT.format(1)}, vals as (select person, coalesce(1 / rank, 0) as rr, case when rank <= 10 then 1 else 0 end as hit, case when rank <= 10 then 1 / log2(rank + 1) else 0 end as ndcg, src in (select src from direct) as found from events_ left join direct using (src, dst))"
_LABELLED = f"{_HELD.format('test')}, labelled as (select s.src, s.dst, round(score, 9) as score, case when h.src is null then 0 else 1 end as label from smooth s left join held h on s.src = h.src and s.dst = h.dst)"

ORACLE_SQL = {
    "load_vectors": f"""with {_VEC}, ids as (select id from roles_a union all select id from roles_b), h as (select id, case when id in (select id from vectors) then case when id like 'b:%' and cast(substr(id, 3) as bigint) % 7 = 0 then 'rejected' else 'loaded' end else 'missing' end as st from ids)
    select count(*) as requested, count(*) filter (st = 'loaded') as loaded, count(*) filter (st = 'missing') as missing, count(*) filter (st = 'rejected') as rejected from h""",
    "vector_norms": f"with {_VEC} select id, round(sqrt(list_sum([cast(x as double) * cast(x as double) for x in vec])), 6) as norm, cast(len(vec) as int) as dim from vectors",
    "knn_join": f"with {_VEC} select id, nbr, round(similarity, 6) as similarity, rank from (select *, row_number() over (partition by id order by similarity desc, nbr) as rank from sims where id like 'a:%') where rank <= {K}",
    "vector_search": f"with {_VEC} select id, nbr as role, round(similarity, 6) as score, rank from (select *, row_number() over (partition by id order by similarity desc, nbr) as rank from sims where id like 'b:%' and nbr like 'a:%') where rank <= 3",
    "similarity_join": f"with {_VEC} select id, nbr, round(similarity, 6) as similarity from sims where id like 'a:%' and nbr like 'b:%' and similarity > 0.15",
    "threshold_sweep": f"""with {_VEC}, p as (select similarity, substr(a.isco_group, 1, 2) = r.isco_group as same from sims join roles_a a using (id) join roles_b r on nbr = r.id
    ), t as (select round(i * 0.02::double, 2) as threshold from range(21) r(i)), c as (select threshold, count(similarity) as predicted, count(*) filter (same) as "true" from t left join p on similarity >= threshold group by threshold
    ), n as (select count(*) as pos from roles_a a join roles_b r on substr(a.isco_group, 1, 2) = r.isco_group where a.id in (select id from unit) and r.id in (select id from unit)
    ), q as (select threshold, predicted, "true", case when predicted > 0 then "true" / predicted else 0 end as precision, case when pos = 0 then 0 else "true" / pos end as recall from c, n
    ), f as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from q)
    select threshold::double as threshold, predicted, "true", round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, row_number() over (order by round(f1, 9) desc, threshold) = 1 as best from f""",
    "transition_walk": f"{CHAIN}, {_WALK} select src, dst, round(p, 6) as p, step from walk",
    "blend_walks": f"{CHAIN}, {_WALK} select src, dst, round(sum(p * case step when 1 then 0.6::double when 2 then 0.3::double else 0.1::double end), 6) as score from walk group by src, dst",
    "softmax_weights": f"{_MODEL}, e as (select id, nbr, exp((similarity - max(similarity) over (partition by id)) / 0.06) as e from nearest) select id, nbr, round(e / sum(e) over (partition by id), 6) as weight from e",
    "smooth_transitions": f"{_MODEL}, {_S} select src, dst, round(score, 6) as score, round(direct, 6) as direct, round(neighbour, 6) as neighbour, support, count, evidence from smooth",
    "smooth_empirical_bayes": f"{_MODEL}, {_SMOOTH.format(mix='(count + 10 * neighbour) / (total + 10)')} select src, dst, round(score, 6) as score, round(direct, 6) as direct, round(neighbour, 6) as neighbour, support, count, evidence from smooth",
    "second_order_scores": f"""{CHAIN}, {_PREFIX.format(src="(select * from kept where split = 'train')")}, {_SECOND}, ctx as (
      select *, sum(count) over (partition by previous, current) as n from (select previous, current, dst, count(*) as count from second group by all)
    ), c3 as (select * from ctx where n >= 3), names as (select distinct previous, current, n from c3
    ), base as (select previous, current, n, c.dst, probability as p from names join counts c on c.src = current and c.count >= 5
    ), both_ as (select previous, current, dst, coalesce(b.n, c3.n) as n, coalesce(p, 0) as p, coalesce(count, 0) as c from base b full join c3 using (previous, current, dst))
    select previous, current, dst, round(0.5 * p + 0.5 * (5 * p + c) / (n + 5), 6) as score from both_""",
    "heldout_metrics": f"""{CHAIN}, {_HELD.format('test')}, {_DIRECT.format(1)}, {metrics_sql('direct', 'held', (1, 3, 5, 10))}
    select sum(n)::bigint as observations, round(sum(rr) / sum(n), 6) as mrr, round(sum(rr) / sum(n) filter (covered), 6) as covered_only_mrr, round(avg(rr / n), 6) as macro_mrr, round(avg(covered::int), 6) as source_role_coverage,
      round(sum(n) filter (covered) / sum(n), 6) as observation_coverage, round(sum(found) / sum(n), 6) as destination_coverage, {_metric_columns((1, 3, 5, 10))} from by_src""",
    "strategy_comparison": f"""{_MODEL}, {_NEAR_10}, {_S}, {_SMOOTH_RANK}, {_DIRECT.format(5)}, {_EVIDENCE}, {_HELD.format('test')}, {_HELD.format('validation').replace('held as', 'held_v as')},
      {', '.join(metrics_sql(p, h, (5, 10), f'_{p}_{h}') for p in _METHODS.values() for h in ('held', 'held_v'))},
      m as ({' union all '.join(f"select '{n}' as method, '{sp}' as split, {_SHORT_RAW} from by_src_{p}_{h}" for n, p in _METHODS.items() for h, sp in (('held', 'test'), ('held_v', 'validation')))})
    select method, split, round(mrr, 6) as mrr, round(hits_5, 6) as hits_5, round(hits_10, 6) as hits_10, round(observation_coverage, 6) as observation_coverage, round(mrr - max(case when method = 'direct' then mrr end) over (partition by split), 6) as mrr_gain from m""",
    "acceptance_gate": f"""{_MODEL}, {_S}, {_SMOOTH_RANK}, {_DIRECT.format(5)}, {_HELD.format('test')}, {metrics_sql('direct', 'held', (5, 10), '_a')}, {metrics_sql('ranked', 'held', (5, 10), '_z')},
      a as (select sum(rr) / sum(n) as m, sum(h5) / sum(n) as h5, sum(h10) / sum(n) as h10, sum(n) filter (covered) / sum(n) as c from by_src_a), z as (select sum(rr) / sum(n) as m, sum(h5) / sum(n) as h5, sum(h10) / sum(n) as h10, sum(n) filter (covered) / sum(n) as c from by_src_z),
      r as (select list_filter([case when z.m <= a.m then 'mrr does not improve' end, case when z.h5 <= a.h5 and z.h10 <= a.h10 then 'no hits improve' end, case when z.c < a.c then 'coverage is lost' end], lambda x: x is not null) as rs from a, z)
    select len(rs) = 0 as accepted, coalesce(array_to_string(rs, '; '), '') as reasons from r""",
    "prefix_metrics": f"{CHAIN}, {_VALUES} select count(*) as events, round(avg(rr), 6) as mrr, round(avg(hit), 6) as hits_10, round(avg(ndcg), 6) as ndcg_10, round(avg(found::int), 6) as coverage from vals",
    "person_bootstrap": f"""{CHAIN}, {_VALUES}, people as (select person, sum(rr) as s, count(*) as n from vals group by person
    ), u as (select s, n, b, (cast('0x' || substr(sha256(person || ':' || b), 1, 8) as bigint) + 0.5::double) / 4294967296 as u from people, range(1, 101) g(b)
    ), d as (select b, s, n, case when u < 0.36787944117144233::double then 0 when u < 0.7357588823428847::double then 1 when u < 0.9196986029286058::double then 2 when u < 0.9810118431238462::double then 3 when u < 0.9963401531726563::double then 4 when u < 0.9994058151824183::double then 5 else 6 end as t from u
    ), m as (select b, sum(t * s) / sum(t * n) as m from d group by b)
    select (select round(sum(s) / sum(n), 6) from people) as mean, round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high from m""",
    "paired_bootstrap": f"""{_MODEL}, {_S}, {_SMOOTH_RANK}, {_EVENTS}, {_DIRECT.format(1)}, v as (
      select person, count(*) as n, sum(coalesce(1 / z.rank, 0) - coalesce(1 / a.rank, 0)) as rr, sum((coalesce(z.rank, 99) <= 10)::int - (coalesce(a.rank, 99) <= 10)::int) as hit
      from events_ e left join direct a on a.src = e.src and a.dst = e.dst left join ranked z on z.src = e.src and z.dst = e.dst group by person
    ), u as (select v.*, b, (cast('0x' || substr(sha256(person || ':' || b), 1, 8) as bigint) + 0.5::double) / 4294967296 as u from v, range(0, 101) g(b)
    ), d as (select *, case when b = 0 then 1 when u < 0.36787944117144233::double then 0 when u < 0.7357588823428847::double then 1 when u < 0.9196986029286058::double then 2 when u < 0.9810118431238462::double then 3 when u < 0.9963401531726563::double then 4 when u < 0.9994058151824183::double then 5 else 6 end as t from u
    ), m as (select b, 'rr' as metric, sum(t * rr) / sum(t * n) as m from d group by b union all select b, 'hit', sum(t * hit) / sum(t * n) from d group by b)
    select metric, round(max(m) filter (b = 0), 6) as gain, round(quantile_cont(m, 0.025) filter (b > 0), 6) as low, round(quantile_cont(m, 0.975) filter (b > 0), 6) as high, round(avg((m > 0)::int) filter (b > 0), 6) as better from m group by metric""",
    "source_ranking_metrics": f"""{_MODEL}, {_S}, {_LABELLED}, r as (select *, row_number() over (partition by src order by score desc, dst) as rank from labelled
    ), p as (select src, min(rank) filter (label = 1) as first, count(*) filter (label = 1) as pos, coalesce(sum(1 / log2(rank + 1)) filter (label = 1 and rank <= 5), 0) as d5, coalesce(sum(1 / log2(rank + 1)) filter (label = 1 and rank <= 10), 0) as d10 from r group by src having count(*) filter (label = 1) > 0)
    select count(*) as sources, round(avg(1 / first), 6) as mrr, {', '.join(f'round(avg((first <= {k})::int), 6) as hits_{k}' for k in (1, 3, 5, 10))},
      round(avg(d5 / list_sum([1 / log2(i + 1) for i in range(1, least(pos, 5) + 1)])), 6) as ndcg_5, round(avg(d10 / list_sum([1 / log2(i + 1) for i in range(1, least(pos, 10) + 1)])), 6) as ndcg_10 from p""",
    "auc_ap": f"""{_MODEL}, {_S}, {_LABELLED}, f as (select cast(cast('0x' || substr(sha256(src), 1, 8) as bigint) % 3 as int) as fold, score, label from labelled
    ), s as (select fold, score, count(*) filter (label = 1) as p, count(*) filter (label = 0) as n from f group by all
    ), x as (select *, coalesce(sum(n) over (partition by fold order by score rows between unbounded preceding and 1 preceding), 0) as below, sum(p) over (partition by fold order by score desc rows between unbounded preceding and current row) as tp, sum(p + n) over (partition by fold order by score desc rows between unbounded preceding and current row) as al from s)
    select fold, round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) as auc, round(sum(p * tp / al) / sum(p), 6) as ap from x group by fold""",
    "full_candidate_rank": f"""{CHAIN}, {_DIRECT.format(5)}, {_HELD.format('test')}, n as (select distinct p_brand as t from part), f as (
      select a.t as src, z.t as dst, row_number() over (partition by a.t order by (a.t = z.t)::int, rank asc nulls last, z.t) as rank from n a cross join n z left join direct on src = a.t and dst = z.t)
    select f.src, f.dst, f.rank from f join held using (src, dst)""",
    "optimistic_rank": f"{CHAIN} select src, dst, rank() over (partition by src order by count desc) as rank from counts",
    "rank_without_sort": f"{CHAIN}, {_HELD.format('test')}, r as (select src, dst, row_number() over (partition by src order by count desc, dst) as rank from counts) select r.* from r join held using (src, dst)",
    "seed_spread": f"""{CHAIN}, {_HELD.format('validation')}, f as (select cast(cast('0x' || substr(sha256(cast(person as varchar)), 1, 8) as bigint) % 4 as int) as fold, src, dst from train_pairs
    ), {', '.join(f"run{i} as (select src, dst, row_number() over (partition by src order by count(*) desc, dst) as rank from f where fold <> {i} group by src, dst), " + metrics_sql(f'run{i}', 'held', (5, 10), f'_{i}') for i in range(4))},
    m as ({' union all '.join(f'select {i} as run, round(sum(rr) / sum(n), 9) as mrr, round(sum(h5) / sum(n), 9) as hits_5, round(sum(h10) / sum(n), 9) as hits_10 from by_src_{i}' for i in range(4))}),
    w as (select run as winner from m order by mrr desc, hits_5 desc, hits_10 desc, run limit 1), e as (select 'mrr' as metric, mrr as v from m union all select 'hits_5', hits_5 from m union all select 'hits_10', hits_10 from m)
    select metric, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std, round(min(v), 6) as low, round(max(v), 6) as high, max(winner) as winner from e, w group by metric""",
    "band_thresholds": f"""{CHAIN}, q as (select least(greatest(quantile_cont(probability, 1.0::double / 3), 0), 1) as low, least(greatest(quantile_cont(probability, 2.0::double / 3), 0), 1) as high from counts)
    select round(low, 6) as low, round(case when high > low then high else least(1, low + 1e-6) end, 6) as high from q""",
    "ordering_inversions": f"""{_MODEL}, {_S}, {_SMOOTH_RANK}, p as (select dst, sum(count) as n from counts group by dst), r as (select src, rank, n from ranked left join p using (dst)
    ), k as (select a.src, count(*) as inv from r a join r z on a.src = z.src and a.rank < z.rank and a.n < z.n group by a.src), g as (select src, count(n) as n, avg(n) filter (rank <= 3) as top_mean from r group by src)
    select title as case, coalesce(g.n, 0) as n, coalesce(inv, 0) as inversions, round(top_mean, 6) as top_mean, coalesce(inv, 0) = 0 as monotone from roles_a left join g on g.src = title left join k on k.src = title""",
    "select_config": f"""{_MODEL}, {_NEAR_10}, {_HELD.format('validation')}, ks(k) as (values {', '.join(f'({k})' for k in GRID[0])}), ws(w) as (values {', '.join(f'({w}::double)' for w in GRID[1])}), ts(t) as (values {', '.join(f'({x}::double)' for x in GRID[2])}
    ), known as (select id, nbr, similarity, k, t from nearest10, ks, ts where rank <= k and nbr in (select src from c5)
    ), e as (select *, exp((similarity - max(similarity) over (partition by k, t, id)) / t) as e from known), u as (select *, e / sum(e) over (partition by k, t, id) as u from e
    ), prior as (select k, t, id as src, dst, sum(u * probability) as nb from u join c5 on nbr = src where dst <> id group by all
    ), dr as (select k, t, src, dst, probability as dp from c5, ks, ts), bo as (select k, t, src, dst, coalesce(dp, 0) as dp, coalesce(nb, 0) as nb, max(dp) over (partition by k, t, src) is not null as hd, max(nb) over (partition by k, t, src) is not null as hn from dr full join prior using (k, t, src, dst)
    ), sc as (select k, t, w, src, dst, round(case when hd and hn then w * dp + (1 - w) * nb when hd then dp else nb end, 9) as score, case when hd and hn then w * dp + (1 - w) * nb when hd then dp else nb end as raw from bo, ws
    ), rk as (select *, row_number() over (partition by k, t, w, src order by score desc, dst) as rank from sc where raw > 0
    ), m as (select k, w as direct_weight, t as temperature, round(sum(count / rank) / (select sum(count) from held), 6) as mrr, round(sum(case when rank <= 5 then count else 0 end) / (select sum(count) from held), 6) as hits_5 from rk join held using (src, dst) group by all)
    select *, row_number() over (order by mrr desc, hits_5 desc, k, direct_weight, temperature) as place from m""",
}
