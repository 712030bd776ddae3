"""Registered queries that score, fuse and describe candidates, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import graph as g
from ..operators import scoring as sc
from ..operators import transitions as tr
from ..operators import vectors as v
from ..sources import bridge as b
from ..sources.shared import staged
from .graph_queries import _FULL as _WHOLE
from .graph_queries import _IDF, GRAPH, alignment_pairs, full_edges, idf_table, nodes, transition_edges
from .model_queries import _DIRECT, _EVIDENCE, _NEAR, _NEAR_10, _S, _SMOOTH_RANK, _VEC, brand_neighbours, direct_predictions, evidence_predictions, held_counts, role_vectors, smooth_full, smooth_predictions
from .trajectory_queries import kept, train_counts

WEIGHTS = {"gap": 0.35, "domain": 0.15, "unsupported": 0.25, "transfer": 0.25}


@staged
def aligned_role(s, d):
    return sc.strongest(alignment_pairs(s, d)).filter("id like 'b:%'")


@staged
def requirements(s, d):
    return sc.role_requirements(nodes(s, d), b.requires(s, d), aligned_role(s, d))


def test_steps(s, d):
    """Kept positions of the people of the test split."""
    return kept(s, d).filter("split = 'test'")


@staged
def owned(s, d):
    """(query_id, skill): what the essential skills of a test person's roles make them know."""
    ess = b.requires(s, d).filter("requirement_level = 'essential'").select("src", F.col("dst").alias("skill"))
    return test_steps(s, d).select(F.col("person").alias("query_id"), F.concat(F.lit("a:"), "label").alias("src")).distinct().join(ess, "src").select("query_id", "skill").distinct()


@staged
def current_roles(s, d):
    return test_steps(s, d).groupBy(F.col("person").alias("query_id")).agg(F.concat(F.lit("a:"), F.max_by("label", "ord")).alias("current"))


def idf(s, d):
    return idf_table(s, d)


def _roles(s, d):
    return requirements(s, d).filter("role like 'a:%'")


@staged
def retrieved(s, d):
    """The twenty roles of each test person whose skills they know best."""
    return sc.overlaps(owned(s, d), _roles(s, d), idf(s, d))


def _smooth_ids(s, d):
    return smooth_full(s, d).select(F.concat(F.lit("a:"), "src").alias("current"), F.concat(F.lit("a:"), "dst").alias("id"), "rank", "evidence", "score", "direct", "count")


def person_lists(s, d):
    """(query_id, list, id, rank): nearest roles of a person's current one, its smoothed transitions, and roles of known skills."""
    cur, n = current_roles(s, d), brand_neighbours(s, d, 10).select(F.concat(F.lit("a:"), "id").alias("current"), F.concat(F.lit("a:"), "nbr").alias("id"), "rank")
    live = nodes(s, d).select("id")
    vector = cur.join(n, "current").join(live, "id", "left_semi").select("query_id", F.lit("vector").alias("list"), "id", "rank")
    moves = cur.join(_smooth_ids(s, d).filter("rank <= 12"), "current").select("query_id", F.lit("transition").alias("list"), "id", "rank")
    again = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    skill = retrieved(s, d).join(cur.hint("merge"), "query_id").filter("role <> current").withColumn("rank", again).select("query_id", F.lit("skill").alias("list"), F.col("role").alias("id"), "rank")
    return vector.unionByName(moves).unionByName(skill)


def live_candidates(s, d):
    """Hits of a vector search that are roles of the graph; the index also holds suppliers, which here are not."""
    hits = v.nearest(role_vectors(s, d).filter("id like 'a:%'"), role_vectors(s, d), 20).select("id", "nbr", "rank")
    graph = b.roles_a(s, d).select(F.col("id").alias("nbr"))
    return hits.join(graph, "nbr", "left_semi").select("id", "nbr", "rank")


@staged
def hybrid(s, d):
    """Candidates of each test person from all signals, filled up by the neighbours' evidence."""
    cur = current_roles(s, d)
    kind = cur.join(_smooth_ids(s, d).filter("rank <= 12"), "current").select("query_id", "id", F.col("evidence").alias("evidence_type"))
    p = evidence_predictions(s, d).filter("rank <= 20").select(F.concat(F.lit("a:"), "src").alias("current"), F.concat(F.lit("a:"), "dst").alias("id"), "rank")
    return sc.hybrid(person_lists(s, d), kind, cur.join(p, "current").select("query_id", "id", "rank"))


@staged
def targets(s, d):
    return hybrid(s, d).select("query_id", F.col("id").alias("role"))


@staged
def target_requirements(s, d):
    """requirements of the roles that are targets or current, without the suppliers', which outnumber them by far."""
    some = targets(s, d).select("role").union(current_roles(s, d).select("current")).distinct()
    return requirements(s, d).join(some, "role", "left_semi")


@staged
def target_lists(s, d):
    return sc.need_lists(target_requirements(s, d), idf(s, d))


@staged
def gap_table(s, d):
    return sc.gaps_of_lists(targets(s, d), target_lists(s, d), owned(s, d))


def hybrid_retrieve(s, d):
    return hybrid(s, d).withColumn("score", F.round("score", 6))


@staged
def by_gap(s, d):
    """Candidates in the order in which they are shown."""
    gap = gap_table(s, d).select("query_id", F.col("role").alias("id"), F.round("accessibility", 9).alias("accessibility"))
    t_ = current_roles(s, d).join(_smooth_ids(s, d).select("current", "id", F.when(F.col("evidence") == "direct_transition", F.col("direct")).otherwise(F.col("score")).alias("strength"), "count"), "current").select("query_id", "id", F.round("strength", 9).alias("strength"), "count")
    # candidates are roles of the first source
    title = b.roles_a(s, d).select("id", g.ascii_label(F.col("title")).alias("title"))
    c = hybrid(s, d).join(gap.hint("merge"), ["query_id", "id"], "left").join(t_.hint("merge"), ["query_id", "id"], "left").join(title, "id")
    return sc.rank_by_gap(c)


def rank_by_gap(s, d):
    return by_gap(s, d).select("query_id", "id", "place", F.round("accessibility", 6).alias("accessibility"), "evidence_type")


def strongest_alignment(s, d):
    return sc.strongest(alignment_pairs(s, d)).withColumn("similarity", F.round("similarity", 6))


def role_requirements(s, d):
    return requirements(s, d)


def requirement_status(s, d):
    """What each role's requirements rest on; suppliers with a key that 3 divides count as unaligned, those that 20 divides as of no known source."""
    key = F.substring("id", 3, 20).cast("long")
    some = nodes(s, d).withColumn("source", F.when(F.col("id").startswith("b:") & (key % 20 == 0), "other").otherwise(F.col("source")))
    like = aligned_role(s, d).filter(key % 3 != 0)
    return sc.requirement_status(some, like, sc.role_requirements(some, b.requires(s, d), like))


def skill_gap(s, d):
    return gap_table(s, d).select("query_id", "role", "required", "owned", F.round("accessibility", 6).alias("accessibility"))


def qualification(s, d):
    return gap_table(s, d).select("query_id", "role", "qualification")


def graph_retrieve(s, d):
    return retrieved(s, d).select("query_id", "role", F.round("score", 6).alias("score"), "rank")


def related_roles(s, d):
    """The ten roles that alignment or training transitions tie most strongly to each role."""
    e = full_edges(s, d).filter((F.col("relation") == "SIMILAR_TO") | tr.is_training()).select("src", "dst", "relation", F.round(F.coalesce("similarity", "probability"), 9).alias("weight"))
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "relation", "dst")
    return e.withColumn("rank", F.row_number().over(w)).filter("rank <= 10").select("src", "dst", "relation", F.round("weight", 6).alias("weight"), "rank")


def isco_distance(s, d):
    """The three distances of groups, over all transitions that are observed."""
    a = b.roles_a(s, d).select("id", "isco_group")
    e = transition_edges(s, d).select("src", "dst").join(a.withColumnRenamed("id", "src"), "src").join(a.select(F.col("id").alias("dst"), F.col("isco_group").alias("h")), "dst")
    two = lambda c: F.substring(c, 1, 2)
    return e.select("src", "dst", F.round(sc.group_distance(F.col("isco_group"), F.col("h")), 6).alias("by_prefix"), sc.step_distance(two("isco_group"), two("h")).alias("by_step"), F.round(sc.scaled_distance(two("isco_group"), two("h")), 6).alias("scaled"))


@staged
def role_overlaps(s, d):
    """(current, role, shared): the idf share of each role's skills that each other one needs, where they share any."""
    have = _roles(s, d).join(idf(s, d).select(F.col("dst").alias("skill"), "idf"), "skill")
    other = have.select(F.col("role").alias("current"), "skill")
    whole = have.groupBy("role").agg(F.sum("idf").alias("all"))
    return have.join(other, "skill").groupBy("current", "role").agg(F.sum("idf").alias("got")).join(whole, "role").select("current", "role", (F.col("got") / F.col("all")).alias("shared"))


@staged
def role_weights(s, d):
    """(role, all): the summed idf of each role's skills."""
    return _roles(s, d).join(idf(s, d).select(F.col("dst").alias("skill"), "idf"), "skill").groupBy("role").agg(F.sum("idf").alias("all"))


@staged
def effort_parts(s, d):
    cur, shared, whole = current_roles(s, d), role_overlaps(s, d), role_weights(s, d)
    group = b.roles_a(s, d).select(F.col("id").alias("role"), "isco_group")
    base = gap_table(s, d).join(cur.hint("merge"), "query_id").join(shared, ["current", "role"], "left").join(whole, "role", "left").join(group, "role").join(group.select(F.col("role").alias("current"), F.col("isco_group").alias("h")), "current")
    e = transition_edges(s, d).select(F.col("src").alias("current"), F.col("dst").alias("role"), F.least(F.lit(1.0), F.col("probability") * F.log2(1.0 + F.col("count"))).alias("support"))
    # without an edge, half the smoothed score of the fifty best
    back = _smooth_ids(s, d).filter("rank <= 50").select("current", F.col("id").alias("role"), (0.5 * F.col("score")).alias("fallback"))
    return base.join(e, ["current", "role"], "left").join(back, ["current", "role"], "left").select(
        "query_id", "role", (F.col("required") - F.col("owned")).alias("missing"), (1 - F.col("accessibility")).alias("gap"), sc.group_distance(F.col("isco_group"), F.col("h")).alias("domain"),
        (1 - F.coalesce("support", "fallback", F.lit(0.0))).alias("unsupported"), F.when(F.col("all").isNotNull(), 1 - F.coalesce("shared", F.lit(0.0))).alias("transfer"),
    )


@staged
def scored_effort(s, d):
    e = sc.effort(effort_parts(s, d), WEIGHTS).withColumn("band", sc.effort_band(F.round("effort", 9)))
    low, high = sc.upskill_weeks(F.col("missing"), F.col("band"))
    return e.select("*", low.alias("weeks_low"), high.alias("weeks_high"))


def effort_score(s, d):
    return scored_effort(s, d).select("query_id", "role", "missing", F.round("effort", 6).alias("effort"), "band", "weeks_low", "weeks_high")


def rank_by_effort(s, d):
    w = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("e"), "role")
    return scored_effort(s, d).withColumn("e", F.round("effort", 9)).withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select("query_id", "role", F.round("e", 6).alias("effort"), "rank")


def shown_roles(s, d):
    """The three first roles of each test person."""
    return by_gap(s, d).filter("place <= 3").select("query_id", F.col("id").alias("role"))


@staged
def analysed_skills(s, d):
    return sc.gap_skills(shown_roles(s, d), target_requirements(s, d), owned(s, d), idf(s, d))


def priority_skills(s, d):
    return analysed_skills(s, d).withColumn("idf", F.round("idf", 6))


def courses(s, d):
    """(course, title, words): a course for every seventh part."""
    title = F.concat("p_name", F.lit(" "), F.lower("p_type"))
    return b.table(s, d, "part").filter("p_partkey % 7 = 0").select(F.format_string("c:%07d", F.col("p_partkey")).alias("course"), title.alias("title"), F.split(title, " ").alias("words"))


def learning_plan(s, d):
    best = sc.best_courses(b.all_skills(s, d).select(F.col("id").alias("skill"), F.split("title", " ").alias("words")), courses(s, d))
    return sc.learning_plan(analysed_skills(s, d).filter("kind = 'priority'"), scored_effort(s, d).select("query_id", "role", "weeks_low", "weeks_high"), best)


def path_skills(s, d):
    return sc.path_skills(by_gap(s, d).filter("place <= 5").select("query_id", F.col("id").alias("role")), target_requirements(s, d))


@staged
def explained(s, d):
    p = by_gap(s, d).filter("place <= 3").join(current_roles(s, d).hint("merge"), "query_id").select("query_id", "current", F.col("id").alias("target"), "evidence_type", "strength")
    like = sc.strongest(alignment_pairs(s, d))
    return sc.explain(p, transition_edges(s, d), like, target_requirements(s, d), owned(s, d))


def explain_path(s, d):
    return explained(s, d)


@staged
def traced(s, d):
    """(query_id, current, id, evidence_type): the three roles shown to each test person."""
    return by_gap(s, d).filter("place <= 3").join(current_roles(s, d).hint("merge"), "query_id").select("query_id", "current", "id", "evidence_type")


@staged
def surroundings(s, d):
    """What lies around each role that is shown or current."""
    some = traced(s, d).select("id").union(traced(s, d).select("current")).distinct()
    return g.surroundings(some, nodes(s, d), full_edges(s, d), tr.is_training())


def candidate_traces(s, d):
    """What lies around each test person's current role and the three roles shown to them, and what evidence ties those to it."""
    c = traced(s, d)
    anchors = c.select("query_id", "id").unionByName(c.select("query_id", F.col("current").alias("id"))).distinct()
    found = surroundings(s, d)
    return g.evidence_triples(g.around(anchors, found), c, found)


def format_explanation(s, d):
    return sc.format_steps(explained(s, d))


def course_queries(s, d):
    """Search texts of each role: with two of its five first essential skills, alone, three skills, and a fallback; each once."""
    first = F.slice(F.array_sort(F.collect_list("dst")), 1, 5)
    own = b.requires(s, d).filter("requirement_level = 'essential'").groupBy(F.col("src").alias("id")).agg(F.transform(first, lambda x: F.substring(x, 3, 100)).alias("skills"))
    r = b.roles_a(s, d).select("id", "title").join(own, "id", "left").withColumn("skills", F.coalesce("skills", F.array().cast("array<string>")))
    pair = F.when(F.size("skills") > 0, F.concat_ws(" ", "title", F.array_join(F.slice("skills", 1, 2), " ")))
    texts = F.array_distinct(F.filter(F.concat(F.array(pair, "title"), F.slice("skills", 1, 3), F.array(F.concat(F.lit("entry level "), "title"))), lambda x: x.isNotNull()))
    return r.select("id", F.posexplode(texts).alias("n", "query"))


def role_lookup(s, d):
    """What is known of each role that a phrase names: its skills, moves, alignment and effort from the test people's roles."""
    phrase = b.table(s, d, "part").select(F.concat(F.lit(" "), F.upper("p_brand"), F.lit("! ")).alias("phrase")).distinct()
    index = g.unique_index(b.roles_a(s, d).withColumn("key", g.normalize_label(F.col("title"))), "key")
    found = phrase.withColumn("key", g.normalize_label(F.col("phrase"))).join(index, "key", "left").select("phrase", "id")
    n = _roles(s, d).groupBy(F.col("role").alias("id")).agg(F.count("*").alias("skills"))
    top = transition_edges(s, d).groupBy(F.col("src").alias("id")).agg(F.min(F.struct((-F.col("probability")).alias("p"), (-F.col("count")).alias("c"), "dst"))["dst"].alias("first_destination"), F.count("*").alias("destinations"))
    like = sc.strongest(alignment_pairs(s, d)).select("id", F.col("partner").alias("aligned"))
    e = scored_effort(s, d).groupBy(F.col("role").alias("id")).agg(F.round(F.avg("effort"), 6).alias("mean_effort"))
    return found.join(n, "id", "left").join(top, "id", "left").join(like, "id", "left").join(e, "id", "left").select("phrase", "id", "skills", "first_destination", "destinations", "aligned", "mean_effort")


def explore_skills(s, d):
    w = Window.orderBy(F.desc("roles"), "skill")
    top = requirements(s, d).groupBy("skill").agg(F.count("*").alias("roles")).orderBy(F.desc("roles"), "skill").limit(20)
    return top.withColumn("rank", F.row_number().over(w))


@staged
def rankings(s, d):
    a = direct_predictions(s, d, 5).select(F.col("src").alias("query_id"), F.lit("direct").alias("list"), F.col("dst").alias("id"), "rank")
    z = smooth_predictions(s, d).select(F.col("src").alias("query_id"), F.lit("smooth").alias("list"), F.col("dst").alias("id"), "rank")
    n = brand_neighbours(s, d).select(F.col("id").alias("query_id"), F.lit("vector").alias("list"), F.col("nbr").alias("id"), "rank")
    return a.unionByName(z).unionByName(n)


def rrf(s, d):
    return sc.rrf(rankings(s, d)).withColumn("score", F.round("score", 6))


#: Fusions of all lists, and of all but one.
LEFT_OUT = (None, "direct", "smooth", "vector")


def signal_ablation(s, d):
    """What the fused ranking loses on held-out people when one of its lists is left out."""
    names = [x for x in LEFT_OUT if x]
    config = lambda out: f"without {out}" if out else "all"
    rows = s.createDataFrame([(config(out), x) for out in LEFT_OUT for x in names if x != out], "config string, list string")
    score = F.round(F.sum(1 / (F.lit(60.0) + F.col("rank"))), 9)
    fused = rankings(s, d).join(F.broadcast(rows), "list").groupBy("config", F.col("query_id").alias("src"), F.col("id").alias("dst")).agg(score.alias("score"))
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("config", "src").orderBy(F.desc("score"), "dst")))
    m = ev.metrics_by(ranked, held_counts(s, d), ["config"], ("split",)).withColumn("mrr", F.round("mrr", 6))
    loss = F.max(F.when(F.col("config") == "all", F.col("mrr"))).over(Window.partitionBy("split")) - F.col("mrr")
    out = m.withColumn("mrr_loss", loss)
    return out.select("config", "split", *[F.round(c, 6).alias(c) for c in ("mrr", "hits_5", "hits_10", "observation_coverage", "mrr_loss")])


#: Weights of three lists in steps of a quarter that sum to one.
SIMPLEX = [(x / 4, y / 4, (4 - x - y) / 4) for x in range(5) for y in range(5 - x)]


def weighted_rrf(s, d):
    """Every weighting of the three lists, and the five best of each source under it."""
    rows = [(f"{x}/{y}/{z}", n, w) for x, y, z in SIMPLEX for n, w in zip(("direct", "smooth", "vector"), (x, y, z), strict=True)]
    w = s.createDataFrame(rows, "config string, list string, weight double")
    out = sc.weighted_rrf_grid(rankings(s, d), w)
    order = Window.partitionBy("config", "query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("score", F.round("score", 9)).filter("score > 0").withColumn("rank", F.row_number().over(order)).filter("rank <= 5").withColumn("score", F.round("score", 6))


def head_fusion(s, d):
    r = rankings(s, d)
    return sc.head_fusion(r.filter("list = 'direct'"), r.filter("list = 'vector'"), 3, 1)


def priority_combine(s, d):
    order = F.when(F.col("list") == "smooth", 1).when(F.col("list") == "direct", 2).otherwise(3)
    return sc.priority_combine(rankings(s, d).filter("not (list = 'smooth' and query_id like '%7')").withColumn("priority", order)).select("query_id", "list", "id", "rank")


def candidate_union(s, d):
    r = rankings(s, d).filter("rank <= 4")
    return r.groupBy("query_id", "id").agg(*[F.max((F.col("list") == x).cast("int")).alias(f"from_{x}") for x in ("direct", "smooth", "vector")])


def channel_topk(s, d):
    return rankings(s, d).filter("rank <= 4")


def rerank_topn(s, d):
    score = (F.col("n") * 31 + F.regexp_extract("id", r"(\d+)$", 1).cast("int") * 17) % 100 / 100.0
    r = sc.rrf(rankings(s, d)).withColumn("n", F.regexp_extract("query_id", r"(\d+)$", 1).cast("int")).withColumn("relevance", score)
    w = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "rank")
    return r.withColumn("place", F.row_number().over(w)).filter("place <= 8").select("query_id", "id", "relevance", "place")


def role_skills(s, d):
    r = requirements(s, d).filter("role like 'a:%'")
    deg = b.requires(s, d).groupBy(F.col("dst").alias("skill")).agg(F.count("*").alias("degree"))
    return r.select("role", "skill").join(deg, "skill").join(idf(s, d).select(F.col("dst").alias("skill"), "idf"), "skill")


@staged
def shared_pairs(s, d):
    """(src, dst, ...) of roles that share a skill."""
    return sc.pair_features(role_skills(s, d))


def title_weights(s, d):
    return sc.tfidf(b.roles_a(s, d).select("id", F.concat(F.lit("brand "), F.regexp_replace("title", "[^0-9]", ""), F.lit(" group "), F.substring("isco_group", 1, 2)).alias("title")))


@staged
def full_pair_features(s, d):
    """All eleven features of pairs that share a skill."""
    vec = role_vectors(s, d).filter("id like 'a:%'")
    group = b.roles_a(s, d).select("id", F.substring("isco_group", 1, 2).alias("g"))
    n = brand_neighbours(s, d, 10).join(train_counts(s, d, 5).select(F.col("src").alias("nbr"), "dst", "probability"), "nbr").groupBy(F.concat(F.lit("a:"), "id").alias("src"), F.concat(F.lit("a:"), "dst").alias("dst")).agg(F.max("probability").alias("evidence"))
    linked = shared_pairs(s, d).filter("cn >= 3").select("src", "dst")
    p = shared_pairs(s, d).join(vec.select(F.col("id").alias("src"), F.col("vec").alias("va")), "src", "left").join(vec.select(F.col("id").alias("dst"), F.col("vec").alias("vb")), "dst", "left")
    p = p.withColumn("cosine", F.coalesce(F.round(v.cosine(F.col("va"), F.col("vb")), 9), F.lit(0.0))).drop("va", "vb")
    p = p.join(group.select(F.col("id").alias("src"), "g"), "src").join(group.select(F.col("id").alias("dst"), F.col("g").alias("h")), "dst").withColumn("group_distance", sc.step_distance(F.col("g"), F.col("h"))).drop("g", "h")
    p = p.join(n, ["src", "dst"], "left").join(sc.title_cosines(title_weights(s, d)), ["src", "dst"], "left").join(sc.meta_paths(linked), ["src", "dst"], "left")
    return p.na.fill(0.0, ["evidence", "title_cosine", "meta", "idf_overlap"])


def pair_features(s, d):
    p = full_pair_features(s, d)
    return p.withColumns({c: F.round(c, 6) for c in ("jaccard", "aa", "ra", "idf_overlap", "cosine", "group_distance", "evidence", "title_cosine", "meta")})


def shared_skill_pairs(s, d):
    return shared_pairs(s, d).filter("cn >= 3").select("src", "dst", "cn")


def meta_path(s, d):
    return sc.meta_paths(shared_skill_pairs(s, d)).withColumn("meta", F.round("meta", 6))


def missing_edge_candidates(s, d):
    a = b.roles_a(s, d).select(F.col("id").alias("src"))
    # every pair of roles is what is asked for: roles are the graph's, not the people's
    pairs = a.crossJoin(a.select(F.col("src").alias("dst"))).filter("src <> dst")
    return pairs.join(transition_edges(s, d).select("src", "dst"), ["src", "dst"], "left_anti")


def title_tfidf(s, d):
    titles = b.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" "), "p_type").alias("title"))
    return sc.tfidf(titles).withColumn("weight", F.round("weight", 6))


def title_cosine(s, d):
    return sc.title_cosines(title_weights(s, d)).withColumn("title_cosine", F.round("title_cosine", 6))


def neighbour_evidence(s, d):
    held = F.col("nbr").endswith("3")
    n = brand_neighbours(s, d, 10).filter(~held)
    c = train_counts(s, d, 5).select(F.col("src").alias("nbr"), "dst", "probability")
    return n.join(c, "nbr").filter("dst <> id").groupBy(F.col("id").alias("src"), "dst").agg(F.round(F.max("probability"), 6).alias("evidence"))


def relevance_grade(s, d):
    c = train_counts(s, d)
    grade = F.when(F.col("count") >= 4, 3).when(F.col("count") >= 2, 2).when(F.col("count") >= 1, 1).otherwise(0)
    return c.select("src", "dst", grade.alias("grade"), F.round(F.log1p("count"), 6).alias("log_count"), F.round(F.col("count") / (F.col("source_total") + 5), 6).alias("shrunk"), (F.col("count") >= 3).alias("at_least_3"))


def skill_set_algebra(s, d):
    """Skills that both roles of an observed transition need, that one of them needs, and that only the first does."""
    r = _roles(s, d).groupBy("role").agg(F.collect_set("skill").alias("s"))
    e = transition_edges(s, d).select("src", "dst")
    j = e.join(r.select(F.col("role").alias("src"), F.col("s").alias("a")), "src").join(r.select(F.col("role").alias("dst"), F.col("s").alias("z")), "dst")
    return j.select("src", "dst", F.size(F.array_intersect("a", "z")).alias("both"), F.size(F.array_union("a", "z")).alias("any"), F.size(F.array_except("a", "z")).alias("only"))


def course_links(s, d):
    """The first links of each page's navigation: canonical path, kind by its first letter, and a title from its slug."""
    scope = F.regexp_extract("html", r"(?s)<nav>(.*?)</nav>", 1)
    m = F.regexp_extract_all(scope, F.lit(r'href="(/[^"?#/]+)'), F.lit(1))
    each = b.table(s, d, "pages").select("page_id", F.posexplode(m).alias("pos", "raw")).withColumn("link", F.lower("raw"))
    first = each.groupBy("page_id", "link").agg(F.min("pos").alias("pos"))
    kind = F.when(F.col("link") < "/m", "course").otherwise("program")
    title = F.trim(F.regexp_replace(F.substring("link", 2, 200), "[-_,.]+", " "))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).select("page_id", "link", kind.alias("kind"), title.alias("title"), "rank")


def user_turns(s, d):
    """What each user said, in order; the question of a conversation (its last text) is put behind it unless it is the last
    thing said."""
    c = b.table(s, d, "conversations")
    said = c.filter((F.col("role") == "user") & (F.trim("text") != "")).select("conv_id", "turn", F.trim("text").alias("text"))
    last = said.groupBy("conv_id").agg(F.max_by("text", "turn").alias("last"), F.max("turn").alias("turn"))
    question = c.groupBy("conv_id").agg(F.max_by(F.trim("text"), "turn").alias("text"))
    more = question.join(last, "conv_id").filter("text <> last").select("conv_id", (F.col("turn") + 1).alias("turn"), "text")
    return said.unionByName(more)


def role_document(s, d):
    r = b.roles_b(s, d)
    doc = F.concat_ws("\n", F.coalesce("title", "id"), F.when(F.col("job_zone") > 2, F.concat(F.lit("Preparation: zone "), F.col("job_zone").cast("string"))), F.concat(F.lit("Education: "), "typical_education_level"))
    return r.select("id", doc.alias("document"))


def short_label(s, d):
    c = F.concat("p_name", F.lit(" "), "p_type", F.lit(" "), "p_brand", F.lit(" edition"))
    return b.table(s, d, "part").select("p_partkey", F.when(F.length(c) > 30, F.concat(F.substring(c, 1, 29), F.lit("…"))).otherwise(c).alias("label"))


QUERIES = {f.__name__: f for f in (
    strongest_alignment, role_requirements, requirement_status, hybrid_retrieve, live_candidates, rank_by_gap, skill_gap, qualification, graph_retrieve, related_roles, isco_distance, effort_score, rank_by_effort,
    priority_skills, learning_plan, path_skills, explain_path, candidate_traces, format_explanation, course_queries, role_lookup, explore_skills, rrf, signal_ablation, weighted_rrf, head_fusion, priority_combine, candidate_union,
    channel_topk, rerank_topn, pair_features, shared_skill_pairs, meta_path, missing_edge_candidates, title_tfidf, title_cosine, neighbour_evidence, relevance_grade, skill_set_algebra, course_links,
    user_turns, role_document, short_label,
)}

#: GRAPH has the role views already.
_BASE = f"{GRAPH}, {_VEC[_VEC.index('vector_ids as'):]}"
_ALIGN = """align as (select id, nbr, similarity from sims where id like 'a:%' and nbr like 'b:%' and similarity > 0.15
), best as (select * from (select *, row_number() over (partition by id order by similarity desc, partner desc) as n from (select id, nbr as partner, similarity from align union all select nbr, id, similarity from align)) where n = 1
), reqs as (
  select src as role, dst as skill, 'direct_esco' as status, src as evidence from requires where requirement_level = 'essential'
  union all select best.id, dst, 'aligned_esco', partner from best join requires on src = partner and requirement_level = 'essential' where best.id like 'b:%'
  union all select src, dst, 'direct_onet', src from requires where importance >= 3.5 and src not in (select id from best)
)"""
_USER = """owned as (select distinct person as query_id, dst as skill from kept join requires on src = 'a:' || label and requirement_level = 'essential' where split = 'test'
), current_ as (select person as query_id, 'a:' || arg_max(label, ord) as cur from kept where split = 'test' group by person
), need as (select role, skill, coalesce(idf, 1) as idf from reqs left join idf on dst = skill
), whole as (select role, sum(idf) as al from need group by role
), gr as (select * from (
  select query_id, role, round(sum(idf) / max(al), 9) as score, row_number() over (partition by query_id order by round(sum(idf) / max(al), 9) desc, role) as rank
  from owned join need using (skill) join whole using (role) where role like 'a:%' group by query_id, role) where rank <= 20
), sm as (select 'a:' || src as cur, 'a:' || dst as id, round(score, 9) as score, direct, count, evidence, row_number() over (partition by src order by round(score, 9) desc, dst) as rank from smooth
), pl as (
  select query_id, 'vector' as list, 'a:' || nbr as id, rank from current_ join nearest10 n on 'a:' || n.id = cur
  union all select query_id, 'transition', id, rank from current_ join sm using (cur) where rank <= 12
  union all select query_id, 'skill', role, row_number() over (partition by query_id order by rank) from gr join current_ using (query_id) where role <> cur
), fu as (select query_id, id, sum(1 / (60 + rank)) as raw, list(list) as ls from pl group by query_id, id
), lp as (select query_id, 'a:' || dst as id, e.rank as place from current_ join evidence e on 'a:' || e.src = cur where e.rank <= 20
), tk as (select query_id, id, evidence as ev from current_ join sm using (cur) where rank <= 12
), hy0 as (select query_id, id, raw, ls, place, ev from fu full join lp using (query_id, id) left join tk using (query_id, id)
), hy as (
  select query_id, id, score, array_to_string(list_sort(list_concat(coalesce(ls, []), case when place is not null then ['predicted'] else [] end)), ',') as sources,
    coalesce(ev, case when place is not null then 'predicted_transition' end) as evidence_type, row_number() over (partition by query_id order by alone, score desc, case when alone then place end, id) as rank
  from (select *, raw is null as alone, case when raw is not null then round(raw, 9) when query_id in (select query_id from fu) then 0 else round(1 / (60 + place), 9) end as score from hy0)
), gapped as (
  select query_id, role, count(*) as required, count(o.skill) as owned, sum(n.idf) as al, sum(case when o.skill is not null then n.idf else 0 end) as got
  from (select query_id, id as role from hy) join need n using (role) left join owned o using (query_id, skill) group by query_id, role
), gap as (select *, case when query_id in (select query_id from owned) then got / al end as acc from gapped
), bg as (
  select *, row_number() over (partition by query_id order by case when anyone and acc is null then 1 else 0 end, case when anyone then -coalesce(acc, -1) else 0 end, bucket, -case when bucket < 2 then coalesce(strength, 0) else 0 end, -coalesce(count, 0), -score, title, id) as place
  from (
    select h.query_id, h.id, current_.cur, h.score, evidence_type, round(acc, 9) as acc, max((acc is not null)::int) over (partition by h.query_id) = 1 as anyone, case evidence_type when 'direct_transition' then 0 when 'neighbour_transition' then 1 else 2 end as bucket,
      round(case when sm.evidence = 'direct_transition' then sm.direct else sm.score end, 9) as strength, sm.count, trim(regexp_replace(lower(r.title), '[^a-z0-9_]+', ' ', 'g')) as title
    from hy h join current_ using (query_id) left join gap on gap.query_id = h.query_id and gap.role = h.id left join sm on sm.cur = current_.cur and sm.id = h.id join nodes r on r.id = h.id)
)"""
_FULL = f"{_BASE}, {_NEAR}, {_NEAR_10}, {_S}, {_SMOOTH_RANK}, {_DIRECT.format(5)}, {_EVIDENCE}, {_IDF}, {_ALIGN}, {_USER}"
_DIST = "case when {a} = {z} then 0 else 1 - (case when substr({a}, 1, 4) = substr({z}, 1, 4) then 4 when substr({a}, 1, 3) = substr({z}, 1, 3) then 3 when substr({a}, 1, 2) = substr({z}, 1, 2) then 2 when substr({a}, 1, 1) = substr({z}, 1, 1) then 1 else 0 end) / 4 end"
_EFFORT = f"""have as (select role, skill, idf from reqs join idf on dst = skill where role like 'a:%'
), hw as (select role, sum(idf) as al from have group by role
), sh as (select o.role as cur, h.role as role, sum(h.idf) as got from have h join have o using (skill) group by all
), parts as (
  select gap.query_id, gap.role, required - gap.owned as missing, 1 - acc as gap, {_DIST.format(a='x.isco_group', z='y.isco_group')} as domain,
    1 - coalesce(case when probability is not null then least(1, probability * log2(1 + trans.count)) end, 0.5::double * sm.score, 0) as unsupported, case when hw.al is not null then 1 - coalesce(sh.got / hw.al, 0) end as transfer
  from gap join current_ using (query_id) left join sh on sh.cur = current_.cur and sh.role = gap.role left join hw on hw.role = gap.role join roles_a x on x.id = gap.role join roles_a y on y.id = current_.cur
    left join trans on trans.src = current_.cur and trans.dst = gap.role left join sm on sm.cur = current_.cur and sm.id = gap.role and sm.rank <= 50
), scored0 as (
  select *, least(greatest((0.35::double * coalesce(gap, 0) + 0.15::double * coalesce(domain, 0) + 0.25::double * coalesce(unsupported, 0) + 0.25::double * coalesce(transfer, 0)) /
    (case when gap is null then 0 else 0.35::double end + case when domain is null then 0 else 0.15::double end + case when unsupported is null then 0 else 0.25::double end + case when transfer is null then 0 else 0.25::double end), 0), 1) as effort from parts
), scored1 as (select *, case when round(effort, 9) <= 0.3 then 'low' when round(effort, 9) <= 0.6 then 'moderate' when effort is not null then 'high' end as band from scored0
), scored as (
  select *, case when missing > 0 then greatest(1, floor(5 * missing * 0.6::double)) when band = 'moderate' then 12 when band = 'high' then 36 else 4 end::int as weeks_low,
    case when missing > 0 then greatest(4, floor(5 * missing * 1.4::double)) when band = 'moderate' then 36 when band = 'high' then 72 else 12 end::int as weeks_high from scored1
)"""
_SKILLS = """sk as (
  select query_id, role, skill, has, idf, idf / sum(idf) over (partition by query_id, role) as part, row_number() over (partition by query_id, role, has order by idf desc, skill) as rank
  from (select b.query_id, b.id as role, n.skill, o.skill is not null as has, round(n.idf, 9) as idf from bg b join need n on n.role = b.id left join owned o on o.query_id = b.query_id and o.skill = n.skill where place <= 3)
), an as (
  select query_id, role, 'priority' as kind, skill, idf, round(part, 4) as share, rank from sk where not has and rank <= 8
  union all select query_id, role, 'blocker', skill, idf, round(part, 4), rank from sk where not has and rank <= 3
  union all select query_id, role, 'quick win', skill, idf, round(part, 4), rank from sk where has and rank <= 5
)"""
_PLAN = """cs as (select printf('c:%07d', p_partkey) as course, p_name || ' ' || lower(p_type) as title from part where p_partkey % 7 = 0
), cw as (select distinct course, title, unnest(string_split(title, ' ')) as word from cs), kw as (select distinct 's:' || p_name as skill, unnest(string_split(p_name, ' ')) as word from part
), bc as (select skill, title from (select skill, course, title, row_number() over (partition by skill order by count(*) desc, course, title) as n from kw join cw using (word) group by skill, course, title) where n = 1
), ph as (select query_id, role, cast((rank - 1) // 3 + 1 as int) as phase, list(an.skill order by rank) as sks, list(bc.title order by rank) as ts from an left join bc on bc.skill = an.skill where kind = 'priority' group by all
), pw as (select *, coalesce((weeks_low + weeks_high) // 2, 0) as total, max(phase) over (partition by query_id, role) as phases from ph left join scored using (query_id, role)
), pp as (select *, case when total > 0 then greatest(2, total // phases) else 4 end as per, list_filter(ts, lambda x: x is not null) as tt from pw)"""
_EXPLAIN = """pr as (select query_id, cur, id as target, evidence_type, strength from bg where place <= 3
), nq as (select p.query_id, p.target, n.skill, o.skill is not null as has, c.skill is not null as mine from pr p join reqs n on n.role = p.target left join owned o on o.query_id = p.query_id and o.skill = n.skill left join reqs c on c.role = p.cur and c.skill = n.skill
), ns as (select *, case when has and mine then 3 when not has then 4 end as step from nq), nr as (select *, row_number() over (partition by query_id, target, step order by skill) as n from ns where step is not null
), ex as (
  select query_id, target, 0 as step, case evidence_type when 'neighbour_transition' then 'SEMANTIC_TRANSITION_BACKOFF' else 'PREDICTED_TRANSITION' end as relation, target as other, round(coalesce(strength, 0), 4) as value, null::bigint as count, null as status from pr where evidence_type in ('neighbour_transition', 'predicted_transition')
  union all select query_id, target, 1, 'TRANSITIONS_TO', target, round(probability, 4), count, null from pr join trans on src = cur and dst = target
  union all select query_id, target, 2, 'SIMILAR_TO', partner, round(similarity, 4), null, null from pr join best on best.id = target
  union all select query_id, target, step, 'REQUIRES', skill, null, null, case step when 3 then 'you_have_this' else 'you_need_this' end from nr where n <= 3
)"""
_LISTS = f"""{_BASE}, {_NEAR}, {_S}, {_SMOOTH_RANK}, lists as (
  select src as query_id, 'direct' as list, dst as id, row_number() over (partition by src order by probability desc, count desc, dst) as rank from counts where count >= 5
  union all select src, 'smooth', dst, rank from ranked union all select id, 'vector', nbr, rank from nearest
), fused as (select *, row_number() over (partition by query_id order by score desc, id) as rank from (select query_id, id, round(sum(1 / (60 + rank)), 9) as score, string_agg(distinct list, ',' order by list) as sources from lists group by query_id, id))"""
_PAIR = """deg_ as (select dst as skill, count(*) as degree from requires group by dst), rs as (select role, skill, degree, idf from reqs join deg_ using (skill) join idf on dst = skill where role like 'a:%'
), sz as (select role, count(*) as n, sum(idf) as al from rs group by role
), pf as (select a.role as src, z.role as dst, count(*) as cn, sum(case when a.degree > 1 then 1 / ln(a.degree) else 0 end) as aa, sum(1 / a.degree) as ra, sum(a.idf) as shared from rs a join rs z using (skill) where a.role <> z.role group by all)"""
_TITLES = """tl as (select id, string_split('brand ' || regexp_replace(title, '[^0-9]', '', 'g') || ' group ' || substr(isco_group, 1, 2), ' ') as w from roles_a
), tt_ as (select id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) as term from tl), tf_ as (select id, term, 1 + ln(count(*)) as tf from tt_ group by all), td_ as (select term, count(*) as df from tf_ group by term
), tw as (select id, term, w / sqrt(sum(w * w) over (partition by id)) as w from (select id, term, tf * (ln((1.0::double + (select count(*) from roles_a)) / (1 + df)) + 1) as w from tf_ join td_ using (term))
), tc as (select a.id as src, z.id as dst, sum(a.w * z.w) as title_cosine from tw a join tw z using (term) where a.id <> z.id group by all)"""
ORACLE_SQL = {
    "strongest_alignment": f"{_FULL} select id, partner, round(similarity, 6) as similarity from best",
    "role_requirements": f"{_FULL} select * from reqs",
    "requirement_status": f"""{_FULL}, ro as (select n.id as role, case when n.id like 'b:%' and try_cast(substr(n.id, 3) as bigint) % 20 = 0 then 'other' else source end as source, partner from nodes n left join best on best.id = n.id and n.id like 'b:%' and try_cast(substr(n.id, 3) as bigint) % 3 <> 0
      ), ev as (select role, case when source = 'esco' then 'direct_esco' when source = 'onet' and partner is not null then 'aligned_esco' when source = 'onet' then 'direct_onet' else 'unsupported_role_source' end as origin, case when source = 'onet' and partner is not null then partner when source <> 'other' then role end as evidence from ro
      ), k as (select role, origin, evidence, count(q.src) as skills from ev left join requires q on q.src = evidence and case when origin = 'direct_onet' then importance >= 3.5 else requirement_level = 'essential' end group by all)
      select role, case when skills > 0 or origin = 'unsupported_role_source' then origin when origin = 'direct_onet' then 'no_esco_alignment' else 'no_requirements' end as status, evidence, skills from k""",
    "skill_gap": f"{_FULL} select query_id, role, required, owned, round(acc, 6) as accessibility from gap",
    "qualification": f"{_FULL} select query_id, role, round(coalesce(acc, 0) + 1e-12, 4) as qualification from gap",
    "graph_retrieve": f"{_FULL} select query_id, role, round(score, 6) as score, rank from gr",
    "hybrid_retrieve": f"{_FULL} select query_id, id, round(score, 6) as score, sources, evidence_type, rank from hy",
    "live_candidates": f"{_BASE} select id, nbr, rank from (select id, nbr, row_number() over (partition by id order by similarity desc, nbr) as rank from sims where id like 'a:%') where rank <= 20 and nbr like 'a:%'",
    "rank_by_gap": f"{_FULL} select query_id, id, place, round(acc, 6) as accessibility, evidence_type from bg",
    "related_roles": f"{_WHOLE} select src, dst, relation, round(weight, 6) as weight, rank from (select src, dst, relation, round(coalesce(similarity, probability), 9) as weight, row_number() over (partition by src order by round(coalesce(similarity, probability), 9) desc, relation, dst) as rank from fe where relation in ('SIMILAR_TO', 'TRANSITIONS_TO')) where rank <= 10",
    "isco_distance": f"""{GRAPH}, d as (select t.src, t.dst, a.isco_group as g, z.isco_group as h, cast(substr(a.isco_group, 1, 2) as int) as x, cast(substr(z.isco_group, 1, 2) as int) as y from trans t join roles_a a on a.id = t.src join roles_a z on z.id = t.dst)
      select src, dst, round({_DIST.format(a='g', z='h')}, 6) as by_prefix, case when x = y then 0 when abs(x - y) <= 5 then 0.5 else 1 end::double as by_step, round(least(abs(x - y) / 90, 1), 6) as scaled from d""",
    "effort_score": f"{_FULL}, {_EFFORT} select query_id, role, missing, round(effort, 6) as effort, band, weeks_low, weeks_high from scored",
    "rank_by_effort": f"{_FULL}, {_EFFORT} select query_id, role, round(e, 6) as effort, rank from (select query_id, role, round(effort, 9) as e, row_number() over (partition by query_id order by round(effort, 9) asc nulls last, role) as rank from scored) where rank <= 5",
    "priority_skills": f"{_FULL}, {_SKILLS} select query_id, role, kind, skill, round(idf, 6) as idf, share, rank from an",
    "learning_plan": f"""{_FULL}, {_EFFORT}, {_SKILLS}, {_PLAN} select query_id, role, phase, 1 + (phase - 1) * per as week_start, phase * per as week_end, case when total > 0 then total else 4 * phases end as weeks_to_ready,
      sks[1] as focus, array_to_string(sks, '|') as skills, array_to_string(list_filter([tt[1], case when tt[2] <> tt[1] then tt[2] when tt[3] <> tt[1] then tt[3] end], lambda x: x is not null), '|') as courses from pp""",
    "explain_path": f"{_FULL}, {_EXPLAIN} select * from ex",
    "candidate_traces": f"""{_FULL}, fe as ({_WHOLE} select * from fe), tc3 as (select query_id, cur, id, evidence_type from bg where place <= 3), an as (select query_id, id from tc3 union select query_id, cur from tc3
      ), x as (select a.query_id, n.source as of_, e.* from an a join nodes n on n.id = a.id join fe e on e.src = a.id)
      select query_id, src, relation, dst from x where (relation = 'REQUIRES' and case when of_ = 'onet' then importance >= 3.5 else requirement_level = 'essential' end) or relation in ('BELONGS_TO', 'BROADER_THAN', 'NARROWER_THAN', 'SIMILAR_TO')
      union select query_id, src, relation, dst from (select x.query_id, x.src, x.relation, x.dst, row_number() over (partition by x.query_id, x.src order by probability desc, count desc, n.title, x.dst) as r from x join nodes n on n.id = x.dst where relation = 'TRANSITIONS_TO') where r <= 8
      union select a.query_id, e.src, e.relation, e.dst from an a join fe e on e.dst = a.id and e.relation = 'SIMILAR_TO'
      union select query_id, cur, case evidence_type when 'neighbour_transition' then 'SEMANTIC_TRANSITION_BACKOFF' when 'predicted_transition' then 'PREDICTED_TRANSITION' else 'TRANSITIONS_TO' end, id from tc3 where evidence_type is not null""",
    "format_explanation": f"""{_FULL}, {_EXPLAIN}, ln as (select query_id, target, step, other, case relation when 'TRANSITIONS_TO' then printf('  -> TRANSITIONS_TO (%.2f%%, n=%d) -> %s', round(value * 100, 2), count, other) when 'SIMILAR_TO' then printf('  -> SIMILAR_TO (%.2f) -> %s', round(value, 2), other)
      when 'PREDICTED_TRANSITION' then printf('  -> PREDICTED_TRANSITION (model score %.2f%%) -> %s', round(value * 100, 2), other) when 'SEMANTIC_TRANSITION_BACKOFF' then printf('  -> SEMANTIC_TRANSITION_BACKOFF (%.2f) -> %s', round(value, 2), other)
      else '  -> REQUIRES -> ' || other || case status when 'you_have_this' then ' (you already have this)' else ' (you need this)' end end as line from ex) select query_id, target, string_agg(line, chr(10) order by step, other) as explanation from ln group by query_id, target""",
    "course_queries": f"""{GRAPH}, o as (select src as id, list(substr(dst, 3) order by dst)[1:5] as sk from requires where requirement_level = 'essential' group by src
      ), q as (select r.id, [case when len(sk) > 0 then title || ' ' || array_to_string(sk[1:2], ' ') end, title, sk[1], sk[2], sk[3], 'entry level ' || title] as qs from roles_a r left join o using (id)
      ), u as (select id, unnest(qs) as query, unnest(range(6)) as pos from q) select id, query, cast(row_number() over (partition by id order by min(pos)) - 1 as int) as n from u where query is not null group by id, query""",
    "role_lookup": f"""{_FULL}, {_EFFORT}, nk as (select role as id, count(*) as skills from reqs group by role), td as (select src as id, first(dst order by probability desc, count desc, dst) as first_destination, count(*) as destinations from trans group by src), me as (select role as id, round(avg(effort), 6) as mean_effort from scored group by role)
      select ' ' || upper(title) || '! ' as phrase, r.id, skills, first_destination, destinations, best.partner as aligned, mean_effort from roles_a r left join nk using (id) left join td using (id) left join best on best.id = r.id left join me on me.id = r.id""",
    "explore_skills": f"{_FULL} select skill, count(*) as roles, row_number() over (order by count(*) desc, skill) as rank from reqs group by skill order by roles desc, skill limit 20",
    "rrf": f"{_LISTS} select query_id, id, round(score, 6) as score, sources, rank from fused",
    "signal_ablation": f"""{_LISTS}, cf(config, list) as (values {', '.join(f"('{f'without {o}' if o else 'all'}', '{x}')" for o in LEFT_OUT for x in LEFT_OUT if x and x != o)}
      ), fr as (select config, query_id as src, id as dst, row_number() over (partition by config, query_id order by round(sum(1 / (60 + rank)), 9) desc, id) as rank from lists join cf using (list) group by config, query_id, id
      ), hd as (select split, src, dst, count(*) as count from classified where reason = 'valid' and split <> 'train' group by all), tt as (select split, sum(count) as n from hd group by split
      ), hi as (select config, split, sum(count / rank) as rr, sum(case when rank <= 5 then count else 0 end) as h5, sum(case when rank <= 10 then count else 0 end) as h10 from fr join hd using (src, dst) group by all
      ), co as (select config, split, sum(count) as c from (select distinct config, src from fr) join hd using (src) group by all
      ), m as (select config, split, coalesce(rr, 0) / n as mrr, coalesce(h5, 0) / n as h5, coalesce(h10, 0) / n as h10, c / n as oc from co join tt using (split) left join hi using (config, split))
      select config, split, round(mrr, 6) as mrr, round(h5, 6) as hits_5, round(h10, 6) as hits_10, round(oc, 6) as observation_coverage, round(max(round(mrr, 6)) filter (config = 'all') over (partition by split) - round(mrr, 6), 6) as mrr_loss from m""",
    "weighted_rrf": f"""{_LISTS}, wg(config, list, weight) as (values {', '.join(f"('{x}/{y}/{z}', '{n}', {v}::double)" for x, y, z in SIMPLEX for n, v in (('direct', x), ('smooth', y), ('vector', z)))}
      ), g as (select config, query_id, id, round(sum(weight / (60 + rank)), 9) as score from lists join wg using (list) group by all), o as (select *, row_number() over (partition by config, query_id order by score desc, id) as rank from g where score > 0)
      select config, query_id, id, round(score, 6) as score, rank from o where rank <= 5""",
    "head_fusion": f"""{_LISTS}, p as (select query_id, id, rank, case when rank <= 3 then 0 else 2 end as tier from lists where list = 'direct'),
      q as (select query_id, id, rank, row_number() over (partition by query_id order by rank, id) as n from lists l where list = 'vector' and (query_id, id) not in (select (query_id, id) from p))
      select query_id, id, row_number() over (partition by query_id order by tier, rank, id) as rank from (select * from p union all select query_id, id, rank, case when n <= 1 then 1 else 3 end from q)""",
    "priority_combine": f"{_LISTS}, x as (select *, case list when 'smooth' then 1 when 'direct' then 2 else 3 end as pr from lists where not (list = 'smooth' and query_id like '%7')) select query_id, list, id, rank from (select *, min(pr) over (partition by query_id) as m from x) where pr = m",
    "candidate_union": f"{_LISTS} select query_id, id, max((list = 'direct')::int) as from_direct, max((list = 'smooth')::int) as from_smooth, max((list = 'vector')::int) as from_vector from lists where rank <= 4 group by all",
    "channel_topk": f"{_LISTS} select * from lists where rank <= 4",
    "rerank_topn": f"{_LISTS}, r as (select query_id, id, rank, (cast(regexp_extract(query_id, '(\\d+)$', 1) as int) * 31 + cast(regexp_extract(id, '(\\d+)$', 1) as int) * 17) % 100 / 100 as relevance from fused) select query_id, id, relevance, place from (select *, row_number() over (partition by query_id order by relevance desc, rank) as place from r) where place <= 8",
    "pair_features": f"""{_FULL}, {_PAIR}, {_TITLES}, ev as (select 'a:' || n.id as src, 'a:' || dst as dst, max(probability) as evidence from nearest10 n join c5 on src = nbr group by all
      ), mp as (select a.src, z.src as dst, log2(1 + count(*)) as meta from (select src, dst from pf where cn >= 3) a join (select src, dst from pf where cn >= 3) z on a.dst = z.dst and a.src <> z.src group by all)
      select pf.src, pf.dst, cn, round(cn / (a.n + z.n - cn), 6) as jaccard, round(aa, 6) as aa, round(ra, 6) as ra, a.n * z.n as pa, round(case when z.al > 0 then shared / z.al end, 6) as idf_overlap, round(coalesce(similarity, 0), 6) as cosine,
        case when x.g = y.g then 0 when abs(x.g - y.g) <= 5 then 0.5 else 1 end::double as group_distance, round(coalesce(evidence, 0), 6) as evidence, round(coalesce(title_cosine, 0), 6) as title_cosine, round(coalesce(meta, 0), 6) as meta
      from pf join sz a on a.role = pf.src join sz z on z.role = pf.dst left join sims on sims.id = pf.src and sims.nbr = pf.dst join (select id, cast(substr(isco_group, 1, 2) as int) as g from roles_a) x on x.id = pf.src join (select id, cast(substr(isco_group, 1, 2) as int) as g from roles_a) y on y.id = pf.dst
        left join ev on ev.src = pf.src and ev.dst = pf.dst left join tc on tc.src = pf.src and tc.dst = pf.dst left join mp on mp.src = pf.src and mp.dst = pf.dst""",
    "shared_skill_pairs": f"{_FULL}, {_PAIR} select src, dst, cn from pf where cn >= 3",
    "meta_path": f"{_FULL}, {_PAIR}, p as (select src, dst from pf where cn >= 3) select a.src, z.src as dst, round(log2(1 + count(*)), 6) as meta from p a join p z on a.dst = z.dst and a.src <> z.src group by all",
    "missing_edge_candidates": f"{GRAPH} select a.id as src, z.id as dst from roles_a a join roles_a z on a.id <> z.id where (a.id, z.id) not in (select (src, dst) from trans)",
    "title_cosine": f"with {b.SQL_ROLES_A}, {_TITLES} select src, dst, round(title_cosine, 6) as title_cosine from tc",
    "title_tfidf": """with w as (select p_partkey as id, list_filter(string_split_regex(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), lambda x: x <> '') as w from part
      ), t as (select id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) as term from w
      ), tf as (select id, term, 1 + ln(count(*)) as tf from t group by all), df as (select term, count(*) as df from tf group by term
      ), x as (select id, term, tf * (ln((1.0::double + (select count(*) from part)) / (1 + df)) + 1) as w from tf join df using (term))
      select id, term, round(w / sqrt(sum(w * w) over (partition by id)), 6) as weight from x""",
    "neighbour_evidence": f"{_BASE}, {_NEAR.replace('rank <= 5', 'rank <= 10')} select id as src, dst, round(max(probability), 6) as evidence from nearest join c5 on src = nbr where nbr not like '%3' and dst <> id group by id, dst",
    "relevance_grade": f"{GRAPH} select src, dst, case when count >= 4 then 3 when count >= 2 then 2 else 1 end as grade, round(ln(1 + count), 6) as log_count, round(count / (source_total + 5), 6) as shrunk, count >= 3 as at_least_3 from counts",
    "skill_set_algebra": f"{_FULL}, r as (select role, list(distinct skill) as s from reqs where role like 'a:%' group by role) select src, dst, len(list_intersect(a.s, z.s))::int as both, len(list_distinct(list_concat(a.s, z.s)))::int as any, len(list_filter(a.s, lambda x: not list_contains(z.s, x)))::int as only from trans join r a on a.role = src join r z on z.role = dst",
    "course_links": r"""with l as (select page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), 'href="(/[^"?#/]+)', 1) as ls from pages), e as (select page_id, lower(unnest(ls)) as link, unnest(range(len(ls))) as pos from l
      ), f as (select page_id, link, min(pos) as pos from e group by all) select page_id, link, case when link < '/m' then 'course' else 'program' end as kind, trim(regexp_replace(substr(link, 2), '[-_,.]+', ' ', 'g')) as title, row_number() over (partition by page_id order by pos) as rank from f""",
    "user_turns": """with s as (select conv_id, turn, trim(text) as text from conversations where role = 'user' and trim(text) <> ''), l as (select conv_id, arg_max(text, turn) as t, max(turn) as turn from s group by conv_id), q as (select conv_id, arg_max(trim(text), turn) as text from conversations group by conv_id)
      select * from s union all select conv_id, l.turn + 1, q.text from q join l using (conv_id) where q.text <> l.t""",
    "role_document": f"with {b.SQL_ROLES_B} select id, concat_ws(chr(10), coalesce(title, id), case when job_zone > 2 then 'Preparation: zone ' || job_zone end, 'Education: ' || typical_education_level) as document from roles_b",
    "short_label": "select p_partkey, case when length(c) > 30 then substr(c, 1, 29) || '…' else c end as label from (select p_partkey, p_name || ' ' || p_type || ' ' || p_brand || ' edition' as c from part)",
}
