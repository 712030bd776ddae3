"""Registered queries over the graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import stores as st
from ..operators import transitions as tr
from ..operators import vectors as v
from ..sources import bridge as b
from ..sources.shared import new_folder, staged
from .model_queries import _VEC, role_vectors
from .trajectory_queries import CHAIN, train_counts

# Names of domains by prefix.
DOMAINS = {"ECO": "Economy", "ECONOMY": "Economy class", "STAND": "Standard", "PROMO": "Promotion"}
COMMON = ["id", "type", "source", "title", "isco_group"]


@staged
def nodes(s, d):
    return b.roles_a(s, d).unionByName(b.roles_b(s, d), allowMissingColumns=True)


def skills(s, d):
    return b.all_skills(s, d)


@staged
def transition_edges(s, d):
    c = train_counts(s, d, 5)
    return c.select(F.concat(F.lit("a:"), "src").alias("src"), F.concat(F.lit("a:"), "dst").alias("dst"), F.lit("TRANSITIONS_TO").alias("relation"), F.lit("trajectory").alias("source"), "count", "source_total", "probability", F.lit("train").alias("split"))


@staged
def every_edge(s, d):
    return b.requires(s, d).select("src", "dst", "relation", "source").unionByName(transition_edges(s, d).select("src", "dst", "relation", "source"))


def union_by_name(s, d):
    return nodes(s, d)


def skill_nodes(s, d):
    return skills(s, d)


def occupation_nodes(s, d):
    """Concrete roles of the first source; roles whose group ends in 9 stand for groups of occupations and are left out."""
    concept = F.when(F.col("isco_group").endswith("9"), "OccupationGroup").otherwise("Occupation")
    n = b.roles_a(s, d).withColumn("concept_type", concept).filter("concept_type = 'Occupation'")
    return n.select("id", "type", "source", "title", F.coalesce(F.when(~F.col("title").endswith("1"), F.concat(F.lit("About "), "title")), F.lit("")).alias("description"), F.coalesce("isco_group", F.lit("")).alias("isco_group"), F.coalesce("esco_code", F.lit("")).alias("esco_code"))


def isco_group_nodes(s, d):
    return b.groups(s, d).filter("type = 'isco_group'").select("id", "type", "source", "title", F.lit("").alias("description"), F.coalesce("code", F.lit("")).alias("code"))


def skill_group_nodes(s, d):
    return b.groups(s, d).filter("type = 'skill_group'").select("id", "type", "source", "title", F.lit("").alias("description"))


def element_domain(s, d):
    return b.table(s, d, "part").groupBy(g.prefix_domain(F.col("p_type"), DOMAINS).alias("domain")).count()


def exclude_domains(s, d):
    return b.table(s, d, "part").withColumn("domain", g.prefix_domain(F.col("p_type"), DOMAINS)).filter(~F.col("domain").isin("Promotion", "Standard")).select("p_partkey", "domain")


def relation_type_norm(s, d):
    raw = b.requires(s, d).select("src", "dst", F.when(F.col("dst").endswith("ring"), F.concat(F.lit(" http://data/model#Related"), F.initcap("requirement_level"), F.lit("Skill "))).when(F.col("dst").endswith("bolt"), "related").otherwise(F.upper("requirement_level")).alias("raw"))
    return raw.withColumn("level", g.relation_type(F.col("raw"))).filter("level is not null").select("src", "dst", "level")


def training_transitions(s, d):
    e = transition_edges(s, d)
    held = e.withColumn("split", F.lit("test")).withColumn("count", F.lit(1).cast("long"))
    return e.unionByName(held).filter(tr.is_training()).select("src", "dst", "count", "split")


def finite_edges(s, d):
    e = transition_edges(s, d).withColumn("probability", F.when(F.col("count") % 7 == 0, F.lit(float("nan"))).when(F.col("count") % 5 == 0, 1.5).otherwise(F.col("probability"))).withColumn("similarity", F.lit(None).cast("double"))
    return e.filter(g.finite(e)).select("src", "dst", "count")


def valid_nodes(s, d):
    t = F.regexp_replace(F.trim("title"), r"\s+", " ")
    return nodes(s, d).filter(F.col("type").isin("role", "skill")).select("id", "type", t.alias("title"), g.normalize_label(t).alias("normalized_title"))


def requirement_filter(s, d):
    """Importance rows that are relevant, not suppressed and of 3 or more. Lines that were returned count as not relevant,
    those of status F as suppressed."""
    l = b.table(s, d, "lineitem").join(b.table(s, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    scale = l.select(
        F.col("l_suppkey").alias("role"), F.col("p_name").alias("skill"), F.explode(F.array(F.struct(F.lit("IM").alias("scale"), (F.col("l_quantity") / 10).alias("value")), F.struct(F.lit("LV").alias("scale"), (F.col("l_discount") * 50).alias("value")))).alias("x"),
        F.when(F.col("l_returnflag") == "R", "Y").alias("not_relevant"), F.when(F.col("l_linestatus") == "F", "Y").otherwise("N").alias("suppress"),
    ).select("role", "skill", "x.scale", "x.value", "not_relevant", "suppress")
    return g.relevant(scale, 3.0).groupBy("role").agg(F.count("*").alias("rows"), F.countDistinct("skill").alias("skills"), F.round(F.max("value"), 6).alias("most"))


def enrich_left(s, d):
    """Job zone title, education, interests and green share beside each role of the second source; what is not known is null."""
    zones = s.createDataFrame(list(b.ZONES.items()), "job_zone int, job_zone_title string")
    e = b.table(s, d, "supplier").select(F.concat(F.lit("b:"), F.col("s_suppkey").cast("string")).alias("id"), F.when(F.col("s_acctbal") > 0, F.round(F.col("s_acctbal") / 10000, 4)).alias("green_share"))
    interests = b.requires(s, d).filter("source = 'onet' and importance >= 3.5").groupBy(F.col("src").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(F.element_at(F.split("dst", " "), -1))), "|").alias("interests"))
    r = b.roles_b(s, d).drop("typical_education_level")
    return r.join(F.broadcast(zones), "job_zone", "left").join(typical_education(s, d), "id", "left").join(interests, "id", "left").join(e, "id", "left").select("id", "job_zone", "job_zone_title", "typical_education_level", "interests", "green_share")


def typical_education(s, d):
    """The education level that most of a supplier's lines carry (by the priority of their orders), the first by name of equals."""
    o = b.table(s, d, "orders").select("o_orderkey", F.element_at(F.array(*map(F.lit, b.LEVELS)), F.substring("o_orderpriority", 1, 1).cast("int")).alias("category"))
    counted = b.table(s, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey", "category").agg(F.count("*").alias("value"))
    first = F.min(F.struct((-F.col("value")).alias("v"), "category"))["category"]
    return counted.groupBy("l_suppkey").agg(first.alias("typical_education_level")).select(F.concat(F.lit("b:"), F.col("l_suppkey").cast("string")).alias("id"), "typical_education_level")


#: Collections by the condition under which a part belongs to them.
COLLECTIONS = {"large": "p_size > 40", "small": "p_size < 5", "dear": "p_retailprice > 1800", "cheap": "p_retailprice < 950", "economy": "p_type = 'ECONOMY'", "promo": "p_type = 'PROMO'", "first": "p_partkey <= 100"}


def membership_flags(s, d):
    """Whether each skill is in each of seven collections: one pass over the members, pivoted, and one join."""
    part = b.table(s, d, "part")
    member = part.select(F.concat(F.lit("s:"), "p_name").alias("id"), *[F.expr(c).alias(n) for n, c in COLLECTIONS.items()]).groupBy("id").agg(*[F.max(n).alias(n) for n in COLLECTIONS])
    return skills(s, d).select("id").join(member, "id", "left").select("id", *[F.coalesce(n, F.lit(False)).alias(n) for n in COLLECTIONS])


def two_scale_join(s, d):
    r = b.requires(s, d).filter("source = 'onet'")
    level = r.filter("level_score > 2").select("src", "dst", "level_score")
    return r.select("src", "dst", "importance").join(level, ["src", "dst"], "left")


def code_to_uri(s, d):
    groups = b.table(s, d, "nation").select(F.concat(F.lit(" "), (10 + F.col("n_nationkey")).cast("string"), F.lit(" ")).alias("code"), F.col("n_name").alias("group_id")).filter("n_nationkey % 3 <> 0")
    return b.roles_b(s, d).join(groups, F.trim("code") == F.col("isco_group")).select("id", "group_id")


def endpoint_exists(s, d):
    some = nodes(s, d).select("id").unionByName(skills(s, d).select("id")).filter("substring(id, -1) <> '3'")
    return g.with_endpoints(b.requires(s, d), some).groupBy("source").agg(F.count("*").alias("edges"))


def fallback_key_join(s, d):
    roles = b.roles_a(s, d).select("id", "isco_group")
    full = roles.filter("isco_group % 2 = 0").groupBy("isco_group").agg(F.min("id").alias("by_full"))
    short = roles.groupBy(F.substring("isco_group", 1, 2).alias("short")).agg(F.min("id").alias("by_short"))
    j = roles.join(full, "isco_group", "left").join(short, F.substring("isco_group", 1, 2) == F.col("short"), "left")
    return j.select("id", F.coalesce("by_full", "by_short").alias("match"))


def label_to_role(s, d):
    n = nodes(s, d).withColumn("key", g.normalize_label(F.col("title")))
    return g.unique_index(n, "key")


@staged
def idf_table(s, d):
    """(dst, idf) of all skills."""
    return g.idf(b.requires(s, d), nodes(s, d).agg(F.count("*").alias("roles")))


def skill_idf(s, d):
    return idf_table(s, d).select("dst", F.round("idf", 6).alias("idf"))


def interest_lists(s, d):
    r = b.requires(s, d).filter("source = 'esco'")
    return r.groupBy("src").agg(F.array_join(F.array_sort(F.collect_set("dst")), "|").alias("skills"), F.array_join(F.array_sort(F.collect_set("requirement_level")), "|").alias("levels"))


def type_histograms(s, d):
    a = nodes(s, d).groupBy("type", "source").count().select(F.lit("node").alias("kind"), F.concat_ws("/", "type", "source").alias("name"), "count")
    return a.unionByName(every_edge(s, d).groupBy("relation").count().select(F.lit("edge").alias("kind"), F.col("relation").alias("name"), "count"))


def label_collisions(s, d):
    p = b.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.lit("skill").alias("type"), F.lit("esco").alias("source"), g.normalize_label(F.col("p_name")).alias("label"))
    return p.groupBy("type", "source", "label").agg(F.countDistinct("id").alias("ids")).filter("ids > 1")


def graph_audit(s, d):
    """Counts of what a graph should not have, one row each."""
    n = nodes(s, d).select("id", "type", "source").unionByName(skills(s, d).select("id", "type", "source")).unionByName(b.groups(s, d).select("id", "type", "source"))
    return g.audit(n, full_edges(s, d), tr.is_training())


def degrees(s, d):
    return g.degrees(every_edge(s, d))


def dedupe_edges(s, d):
    r = b.requires(s, d)
    doubled = r.unionByName(r.withColumn("requirement_level", F.lit("optional")))
    first = g.dedupe(doubled, ["src", "dst", "relation", "source"], F.desc(F.col("requirement_level") == "essential"), F.asc_nulls_last("requirement_level"))
    return first.groupBy("source", "requirement_level").count()


def group_sizes(s, d):
    return nodes(s, d).groupBy(F.substring("isco_group", 1, 2).alias("isco_2digit")).agg(F.count("*").alias("members"))


def isco_2digit(s, d):
    return nodes(s, d).select("id", F.when((F.col("source") == "esco") & F.col("isco_group").rlike(r"^\d{2}"), F.substring("isco_group", 1, 2)).alias("isco_2digit"))


def same_group_edges(s, d):
    roles = nodes(s, d).select("id", F.substring("isco_group", 1, 2).alias("isco_2digit"))
    return g.same_group_edges(roles, g.degrees(every_edge(s, d)), transition_edges(s, d), 3)


def prune_graph(s, d):
    n = nodes(s, d).select("id", "type").unionByName(skills(s, d).select("id", "type"))
    kept, edges = g.prune(n, b.requires(s, d), 30)
    return kept.groupBy("type").agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))


def derive_entities(s, d):
    n = b.roles_b(s, d)
    q, qe = g.derived_entities(n, "typical_education_level", F.trim("typical_education_level"), "derived:qualification:", "qualification", "TYPICALLY_REQUIRES_QUALIFICATION")
    j, je = g.derived_entities(n, "job_zone", F.concat(F.lit("Job Zone "), F.col("job_zone").cast("string")), "derived:job-zone:", "job_zone", "IN_JOB_ZONE")
    roles = qe.unionByName(je).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("roles"))
    return q.unionByName(j).join(roles, "id").select("id", "title", "type", "roles")


def enrich_graph(s, d):
    """Roles with two-digit groups (by their own code, or that of the first role of their full or shortened code) and their skills' idf."""
    own = F.when((F.col("source") == "esco") & F.col("isco_group").rlike(r"^\d{2}"), F.substring("isco_group", 1, 2))
    match = fallback_key_join(s, d)
    sums = b.requires(s, d).join(idf_table(s, d), "dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("skills"), F.round(F.sum("idf"), 6).alias("idf_sum"))
    return nodes(s, d).select("id", own.alias("isco_2digit")).join(match, "id", "left").join(sums, "id", "left").select("id", "isco_2digit", "match", F.coalesce("skills", F.lit(0)).alias("skills"), F.coalesce("idf_sum", F.lit(0.0)).alias("idf_sum"))


def replace_edges(s, d):
    """Kinds of a store replaced one after the other: transitions by those of more support, twice; an older alignment by
    nothing; a kind that wasn't there by the pairs of equal groups."""
    folder = new_folder(s, "replaced")
    old = transition_edges(s, d).select("src", "dst", F.lit("SIMILAR_TO").alias("relation"), F.lit("alignment").alias("source"))
    st.sink_edges(every_edge(s, d).unionByName(old), folder)
    every = nodes(s, d).select("id")
    for _ in range(2):
        st.replace_edges(every, transition_edges(s, d).filter("count >= 6").select("src", "dst"), folder, "TRANSITIONS_TO", "trajectory")
    st.replace_edges(every, old.filter("false").select("src", "dst"), folder, "SIMILAR_TO", "alignment")
    role = b.roles_a(s, d).select("id", "isco_group")
    pairs = role.select(F.col("id").alias("src"), "isco_group").join(role.select(F.col("id").alias("dst"), "isco_group"), "isco_group").filter("src < dst").select("src", "dst")
    st.replace_edges(every, pairs, folder, "SAME_GROUP", "isco")
    return s.read.schema("src string, dst string, relation string, source string").parquet(folder).groupBy("relation", "source").agg(F.count("*").alias("count"))


@staged
def alignment_pairs(s, d):
    """(id, nbr, similarity): alignments of roles of both sources."""
    vec = role_vectors(s, d)
    return v.similar_pairs(vec.filter("id like 'a:%'"), vec.filter("id like 'b:%'"), 0.15)


def taxonomy_edges(s, d):
    roles = b.roles_a(s, d)
    raw = b.requires(s, d).filter("source = 'esco'").select(F.col("src").alias("role"), F.col("dst").alias("skill"), F.col("requirement_level").alias("relation_type"))
    code = F.concat(F.lit("i:"), "isco_group")
    parts = [
        g.requirement_edges(raw), g.membership_edges(roles, b.groups(s, d).filter("code is not null").select("code", F.col("id").alias("group_id"))),
        g.both_ways(roles.select("isco_group").distinct().select(code.alias("id"), F.concat(F.lit("i:"), F.substring("isco_group", 1, 2)).alias("broader"))),
        g.both_ways(roles.select("id", code.alias("broader")), "occupations"), g.level_edges(b.skill_levels(s, d), ["level_0", "level_1", "level_2"]), g.skill_relation_edges(b.skill_relations(s, d)),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


@staged
def full_edges(s, d):
    """All edges with all their attributes: taxonomy, requirements of the second source, transitions and alignment."""
    e = taxonomy_edges(s, d).unionByName(b.requires(s, d).filter("source = 'onet'"), allowMissingColumns=True).unionByName(transition_edges(s, d), allowMissingColumns=True)
    every = nodes(s, d).select("id")
    return g.alignment_edges(e.withColumn("similarity", F.lit(None).cast("double")), every, alignment_pairs(s, d))


def alignment_edges(s, d):
    """An older alignment replaced by both directions of the new one."""
    old = transition_edges(s, d).select("src", "dst", F.lit("SIMILAR_TO").alias("relation"), F.lit("alignment").alias("source"), F.lit(0.5).alias("similarity"))
    new = g.alignment_edges(old.unionByName(every_edge(s, d), allowMissingColumns=True), nodes(s, d), alignment_pairs(s, d))
    return new.groupBy("relation", "source").agg(F.count("*").alias("edges"), F.round(F.sum("similarity"), 6).alias("similarity"))


def build_graph(s, d):
    """Both sources as one graph. The second frame of edges says more about rings; a third has an end that no node is."""
    first = b.requires(s, d)
    more = first.filter("dst like '%ring'").select("src", "dst", "relation", "source", F.lit(9.9).alias("level_score"), F.lit(None).cast("double").alias("importance"))
    lost = first.select("src", F.lit("s:nothing").alias("dst"), "relation", "source").distinct()
    _, edges = g.build([b.roles_a(s, d), b.roles_b(s, d), skills(s, d)], [first, more, lost, transition_edges(s, d)])
    return edges.select("src", "dst", "edge_key", "requirement_level", "importance", "level_score", "count")


def dirty_nodes(s, d):
    """All nodes, with job zone titles; anvils get a type that isn't allowed, suppliers whose key ends in 5 a blank title."""
    zones = s.createDataFrame(list(b.ZONES.items()), "job_zone int, job_zone_title string")
    n = nodes(s, d).unionByName(skills(s, d), allowMissingColumns=True).unionByName(b.groups(s, d), allowMissingColumns=True).join(F.broadcast(zones), "job_zone", "left")
    return n.withColumn("type", F.when(F.col("id").startswith("s:") & F.col("id").endswith("anvil"), "thing").otherwise(F.col("type"))).withColumn("title", F.when(F.col("id").startswith("b:") & F.col("id").endswith("5"), " ").otherwise(F.concat(F.lit(" "), "title")))


def dirty_edges(s, d):
    """All edges, with a loop at each role, transitions of other splits, probabilities that are no numbers, and doubles."""
    e = full_edges(s, d)
    loops = b.roles_a(s, d).select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit("SIMILAR_TO").alias("relation"), F.lit("alignment").alias("source"))
    t = e.filter("relation = 'TRANSITIONS_TO'")
    held = t.filter("count % 3 = 0").withColumn("split", F.lit("test"))
    odd = t.filter("count % 2 = 0").withColumn("probability", F.lit(float("nan"))).withColumn("source_total", F.lit(1).cast("long"))
    double = e.filter("requirement_level = 'essential'").withColumn("requirement_level", F.lit("optional"))
    return e.unionByName(loops, allowMissingColumns=True).unionByName(held).unionByName(odd).unionByName(double)


@staged
def _dirty_nodes(s, d):
    return dirty_nodes(s, d)


@staged
def _dirty_edges(s, d):
    return dirty_edges(s, d)


def improve_quality(s, d):
    """What the improved graph has of each type and relation."""
    n, e, _ = g.improve(_dirty_nodes(s, d), _dirty_edges(s, d), tr.is_training())
    return n.groupBy(F.col("type").alias("name")).count().unionByName(e.groupBy(F.col("relation").alias("name")).count())


def graph_quality_report(s, d):
    return g.improve(_dirty_nodes(s, d), _dirty_edges(s, d), tr.is_training())[2]


def traverse(s, d):
    """What lies around every role, each being its own question."""
    n = nodes(s, d)
    return g.traverse(n.select(F.col("id").alias("query_id"), "id"), n, full_edges(s, d), tr.is_training())


def normalize_properties(s, d):
    """Properties of roles of the second source as JSON without what is null or no finite number; empty lists stay."""
    n = F.when(F.col("job_zone") == 3, F.lit(float("nan"))).when(F.col("job_zone") == 4, F.lit(float("inf"))).otherwise(F.col("job_zone") / 2)
    r = b.roles_b(s, d).withColumn("half", n).withColumn("tags", F.when(F.col("job_zone") > 2, F.array(F.lit("b"), "source")).otherwise(F.array().cast("array<string>")))
    r = r.withColumn("isco_group", F.when(F.col("job_zone") != 1, F.col("isco_group")))
    return r.select("id", g.properties(r, ["half", "isco_group", "job_zone", "tags"]).alias("properties"), g.scalar_properties(r, ["half", "isco_group", "job_zone", "tags"]).alias("payload"))


def entity_keys(s, d):
    key = F.concat(F.lit("graph::"), F.col("id"))
    return nodes(s, d).select("id", key.alias("entity_key"), g.uuid5(key).alias("point_id"))


def json_attrs(s, d):
    return b.roles_b(s, d).select("id", F.to_json(F.struct("isco_group", "job_zone", "source")).alias("attrs"))


def slug(s, d):
    return b.table(s, d, "part").select(g.slug(F.concat(F.lit("  Straße "), "p_name", F.lit(" / "), "p_type", F.lit("!"))).alias("slug")).groupBy("slug").count()


def normalize_label(s, d):
    label = g.normalize_label(F.concat(F.lit("(Straße \ufb01n \uff2eo_1 "), "p_name", F.lit(") -- "), "p_brand"))
    return b.table(s, d, "part").select(label.alias("label")).groupBy("label").count()


def graph_sample(s, d):
    """What a picture of the graph shows: roles of highest degree, alignments among them, the strongest transitions and some skills."""
    return g.sample(nodes(s, d), full_edges(s, d), roles=60, transitions=120, skills=4, most_skills=160)


def k_hop_reachability(s, d):
    """Roles within three steps of every role."""
    starts = b.roles_a(s, d).select(F.col("id").alias("query_id"), "id")
    return g.reach(transition_edges(s, d), starts, 3)


def best_evidence(s, d):
    """The best training edge of each pair, of those of two supports and an older, better looking one of another split."""
    e = transition_edges(s, d)
    twice = e.unionByName(e.withColumn("probability", F.col("probability") / 2)).unionByName(e.withColumn("probability", F.lit(1.0)).withColumn("split", F.lit("test")))
    best = twice.filter(tr.is_training()).groupBy("src", "dst").agg(F.max(F.struct(F.round("probability", 9).alias("p"), "count", "source_total")).alias("m"))
    return best.select("src", "dst", F.round("m.p", 6).alias("probability"), "m.count", "m.source_total")


QUERIES = {f.__name__: f for f in (
    union_by_name, skill_nodes, occupation_nodes, isco_group_nodes, skill_group_nodes, element_domain, exclude_domains, relation_type_norm, training_transitions, finite_edges,
    valid_nodes, requirement_filter, enrich_left, typical_education, membership_flags, two_scale_join, code_to_uri, endpoint_exists, fallback_key_join, label_to_role, skill_idf, interest_lists, type_histograms,
    label_collisions, graph_audit, degrees, dedupe_edges, group_sizes, isco_2digit, same_group_edges, prune_graph, derive_entities, enrich_graph, replace_edges, taxonomy_edges, alignment_edges, build_graph,
    improve_quality, graph_quality_report, traverse, normalize_properties, entity_keys, json_attrs, slug, normalize_label, graph_sample, k_hop_reachability, best_evidence,
)}

_NODES = f"{b.SQL_ROLES_A}, {b.SQL_ROLES_B}, nodes as (select id, type, source, title, isco_group, esco_code, null::int as job_zone, null::varchar as typical_education_level from roles_a union all select id, type, source, title, isco_group, null, job_zone, typical_education_level from roles_b), skills as (select distinct 's:' || p_name as id, 'skill' as type, 'esco' as source, p_name as title from part)"
_TRANS = "trans as (select 'a:' || src as src, 'a:' || dst as dst, 'TRANSITIONS_TO' as relation, 'trajectory' as source, count, source_total, probability from counts where count >= 5)"
GRAPH = f"{CHAIN}, {_NODES}, {b.SQL_REQUIRES}, {_TRANS}, every_edge as (select src, dst, relation, source from requires union all select src, dst, relation, source from trans)"
_DEG = "deg as (select id, count(*) as degree from (select src as id from every_edge union all select dst from every_edge) group by id)"
_DOMAIN = "case when starts_with(p_type, 'ECONOMY') then 'Economy class' when starts_with(p_type, 'PROMO') then 'Promotion' when starts_with(p_type, 'STAND') then 'Standard' when starts_with(p_type, 'ECO') then 'Economy' else 'Domain-' || split_part(p_type, '.', 1) end"
_EDUCATION = """education as (select 'b:' || k as id, category as typical_education_level from (
  select l_suppkey as k, ['PhD', 'Master', 'Bachelor', 'Secondary school', 'None'][cast(substr(o_orderpriority, 1, 1) as int)] as category, row_number() over (partition by l_suppkey order by count(*) desc, category) as n from lineitem join orders on l_orderkey = o_orderkey group by 1, 2) where n = 1)"""
_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9_]+', ' ', 'g'))"
#: Everything that the whole graph holds: taxonomy, requirements, transitions and alignment of both directions.
_FULL = f"""{GRAPH}, {_VEC[_VEC.index('vector_ids as'):]}, {b.SQL_TAXONOMY}, al as (select id, nbr, similarity from sims where id like 'a:%' and nbr like 'b:%' and similarity > 0.15
), fe as (
  select src, dst, relation, source, pillar, requirement_level, null::double as importance, null::double as level_score, null::bigint as count, null::bigint as source_total, null::double as probability, null::varchar as split, null::double as similarity from tax
  union all select src, dst, relation, source, null, null, importance, level_score, null, null, null, null, null from requires where source = 'onet'
  union all select src, dst, relation, source, null, null, null, null, count, source_total, probability, 'train', null from trans
  union all select id, nbr, 'SIMILAR_TO', 'alignment', null, null, null, null, null, null, null, null, similarity from al union all select nbr, id, 'SIMILAR_TO', 'alignment', null, null, null, null, null, null, null, null, similarity from al
)"""
_FDEG = "fdeg as (select id, count(*) as degree from (select src as id from fe union all select dst from fe) group by id)"
_DIRTY = f"""{_FULL}, dn as (
  select id, case when id like 's:%anvil' then 'thing' else type end as type, source, case when id like 'b:%5' then '' else title end as title, job_zone, typical_education_level as edu
  from (select id, type, source, title, job_zone, typical_education_level from nodes union all select id, type, source, title, null, null from skills union all select id, type, source, title, null, null from groups_)
), good as (select * from dn where title <> '' and type <> 'thing'
), de as (
  select src, dst, relation, source, requirement_level, count, probability, similarity, 'train' as split, false as nan from fe
  union all select id, id, 'SIMILAR_TO', 'alignment', null, null, null, null, null, false from roles_a
  union all select src, dst, relation, source, null, count, probability, null, 'test', false from fe where relation = 'TRANSITIONS_TO' and count % 3 = 0
  union all select src, dst, relation, source, null, count, null, null, 'train', true from fe where relation = 'TRANSITIONS_TO' and count % 2 = 0
  union all select src, dst, relation, source, 'optional', null, null, null, null, false from fe where requirement_level = 'essential'
), rs as (
  select *, case when src not in (select id from good) or dst not in (select id from good) then 'invalid' when src = dst then 'self_loop' when relation = 'TRANSITIONS_TO' and split = 'test' then 'held_out' when nan then 'not_finite' else 'kept' end as r from de
), ke as (select distinct src, dst, relation, source from rs where r = 'kept'
), us as (select src as id from ke union select dst from ke), li as (select * from good where id in (select id from us)
), q as (select 'derived:qualification:' || replace(lower(trim(edu)), ' ', '-') as id, edu as title, id as role from li where type = 'role' and source = 'onet' and edu is not null
), jz as (select 'derived:job-zone:' || job_zone as id, coalesce({b.SQL_ZONE}, 'Job Zone ' || job_zone) as title, id as role from li where type = 'role' and source = 'onet'
), nn as (select id, type, source, title from li union all select distinct id, 'qualification', 'onet', title from q union all select distinct id, 'job_zone', 'onet', title from jz
), ee as (select relation from ke union all select 'TYPICALLY_REQUIRES_QUALIFICATION' from q union all select 'IN_JOB_ZONE' from jz)"""
_IDF = "idf as (select dst, ln((select count(*) from nodes) / count(*)) as idf from requires group by dst)"
ORACLE_SQL = {
    "union_by_name": f"with {_NODES} select * from nodes",
    "skill_nodes": f"with {_NODES} select * from skills",
    "occupation_nodes": f"with {b.SQL_ROLES_A} select id, type, source, title, case when title like '%1' then '' else 'About ' || title end as description, isco_group, esco_code from roles_a where isco_group not like '%9'",
    "isco_group_nodes": f"with {b.SQL_ROLES_A}, {b.SQL_REQUIRES}, {b.SQL_TAXONOMY} select id, type, source, title, '' as description, code from groups_ where type = 'isco_group'",
    "skill_group_nodes": f"with {b.SQL_ROLES_A}, {b.SQL_REQUIRES}, {b.SQL_TAXONOMY} select id, type, source, title, '' as description from groups_ where type = 'skill_group'",
    "element_domain": f"select {_DOMAIN} as domain, count(*) as count from part group by 1",
    "exclude_domains": f"select p_partkey, domain from (select p_partkey, {_DOMAIN} as domain from part) where domain not in ('Promotion', 'Standard')",
    "relation_type_norm": f"with {b.SQL_REQUIRES} select src, dst, requirement_level as level from requires where requirement_level is not null and dst not like '%bolt'",
    "training_transitions": f"{GRAPH} select src, dst, count, 'train' as split from trans",
    "finite_edges": f"{GRAPH} select src, dst, count from trans where count % 7 <> 0 and count % 5 <> 0",
    "valid_nodes": f"with {_NODES} select id, type, title, {_NORM.format('title')} as normalized_title from nodes",
    "requirement_filter": "select l_suppkey as role, count(*) as rows, count(distinct p_name) as skills, round(max(l_quantity / 10), 6) as most from lineitem join part on l_partkey = p_partkey where l_returnflag <> 'R' and l_linestatus <> 'F' and l_quantity / 10 >= 3 group by l_suppkey",
    "enrich_left": f"""with {b.SQL_ROLES_B}, {b.SQL_REQUIRES}, {_EDUCATION}, i as (select src as id, string_agg(distinct split_part(dst, ' ', -1), '|' order by split_part(dst, ' ', -1)) as interests from requires where source = 'onet' and importance >= 3.5 group by src
      ) select r.id, job_zone, {b.SQL_ZONE} as job_zone_title, e.typical_education_level, interests, case when s_acctbal > 0 then round(s_acctbal / 10000, 4) end as green_share
      from roles_b r left join education e on e.id = r.id left join i on i.id = r.id left join supplier on r.id = 'b:' || s_suppkey""",
    "typical_education": f"with {_EDUCATION} select id, typical_education_level from education",
    "membership_flags": f"with {_NODES} select id, " + ", ".join(f"title in (select p_name from part where {c}) as {n}" for n, c in COLLECTIONS.items()) + " from skills",
    "two_scale_join": f"with {b.SQL_REQUIRES} select src, dst, importance, case when level_score > 2 then level_score end as level_score from requires where source = 'onet'",
    "code_to_uri": f"with {b.SQL_ROLES_B} select id, n_name as group_id from roles_b join nation on isco_group = cast(10 + n_nationkey as varchar) where n_nationkey % 3 <> 0",
    "endpoint_exists": f"{GRAPH}, ok as (select id from nodes where right(id, 1) <> '3' union all select id from skills where right(id, 1) <> '3') select source, count(*) as edges from requires where src in (select id from ok) and dst in (select id from ok) group by source",
    "fallback_key_join": f"with {b.SQL_ROLES_A}, f as (select isco_group, min(id) as m from roles_a where cast(isco_group as int) % 2 = 0 group by 1), s as (select substr(isco_group, 1, 2) as k, min(id) as m from roles_a group by 1) select r.id, coalesce(f.m, s.m) as match from roles_a r left join f using (isco_group) left join s on k = substr(r.isco_group, 1, 2)",
    "label_to_role": f"with {_NODES}, k as (select {_NORM.format('title')} as key, id from nodes) select key, min(id) as id from k group by key having count(distinct id) = 1",
    "skill_idf": f"{GRAPH}, {_IDF} select dst, round(idf, 6) as idf from idf",
    "interest_lists": f"with {b.SQL_REQUIRES} select src, string_agg(distinct dst, '|' order by dst) as skills, string_agg(distinct requirement_level, '|' order by requirement_level) as levels from requires where source = 'esco' group by src",
    "type_histograms": f"{GRAPH} select 'node' as kind, type || '/' || source as name, count(*) as count from nodes group by type, source union all select 'edge', relation, count(*) from every_edge group by relation",
    "label_collisions": f"select 'skill' as type, 'esco' as source, {_NORM.format('p_name')} as label, count(distinct p_partkey) as ids from part group by 3 having count(distinct p_partkey) > 1",
    "graph_audit": f"""{_FULL}, every as (select id, type, source from nodes union all select id, type, source from skills union all select id, type, source from groups_), used as (select src as id from fe union select dst from fe)
      select 'isolate' as "check", type as name, count(*) as n from every where id not in (select id from used) group by type
      union all select 'missing endpoint', relation, count(*) from (select distinct src, dst, relation from fe where src not in (select id from every) or dst not in (select id from every)) group by relation
      union all select 'no requirements', source, count(*) from nodes where id not in (select src from fe where relation = 'REQUIRES') group by source
      union all select 'source', 'sum over one', count(*) from (select src from trans group by src having sum(probability) > 1 + 1e-9)""",
    "degrees": f"{GRAPH}, {_DEG} select * from deg",
    "dedupe_edges": f"with {b.SQL_REQUIRES} select source, coalesce(requirement_level, 'optional') as requirement_level, count(*) as count from requires group by 1, 2",
    "group_sizes": f"with {_NODES} select substr(isco_group, 1, 2) as isco_2digit, count(*) as members from nodes group by 1",
    "isco_2digit": f"with {_NODES} select id, case when source = 'esco' then substr(isco_group, 1, 2) end as isco_2digit from nodes",
    "same_group_edges": f"{GRAPH}, {_DEG}, t as (select * from (select n.id, substr(isco_group, 1, 2) as k, row_number() over (partition by substr(isco_group, 1, 2) order by coalesce(degree, 0) desc, n.id) as r from nodes n left join deg using (id)) where r <= 3) select a.id as src, z.id as dst from t a join t z on a.k = z.k and a.id <> z.id where (a.id, z.id) not in (select (src, dst) from trans)",
    "prune_graph": f"{GRAPH}, poor as (select n.id from nodes n left join (select src, count(*) as c from requires group by src) r on r.src = n.id where coalesce(c, 0) < 30), e as (select * from requires where src not in (select id from poor)), used as (select src as id from e union select dst from e), k as (select id, type from nodes where id not in (select id from poor) union all select id, type from skills) select type, count(*) as nodes, (select count(*) from e) as edges from k where id in (select id from used) group by type",
    "derive_entities": f"with {b.SQL_ROLES_B} select 'derived:qualification:' || replace(lower(typical_education_level), ' ', '-') as id, arg_min(typical_education_level, id) as title, 'qualification' as type, count(*) as roles from roles_b group by 1 union all select 'derived:job-zone:' || job_zone, 'Job Zone ' || job_zone, 'job_zone', count(*) from roles_b group by job_zone",
    "enrich_graph": f"""{GRAPH}, {_IDF}, f as (select isco_group, min(id) as m from roles_a where cast(isco_group as int) % 2 = 0 group by 1), h as (select substr(isco_group, 1, 2) as k, min(id) as m from roles_a group by 1),
      mt as (select r.id, coalesce(f.m, h.m) as match from roles_a r left join f using (isco_group) left join h on k = substr(r.isco_group, 1, 2)), su as (select src, count(*) as skills, round(sum(idf), 6) as idf_sum from requires join idf using (dst) group by src)
      select n.id, case when source = 'esco' then substr(isco_group, 1, 2) end as isco_2digit, match, coalesce(skills, 0) as skills, coalesce(idf_sum, 0) as idf_sum from nodes n left join mt using (id) left join su on su.src = n.id""",
    "replace_edges": f"""{GRAPH} select 'REQUIRES' as relation, source, count(*) as count from requires group by source union all select 'TRANSITIONS_TO', 'trajectory', count(*) from trans where count >= 6 having count(*) > 0
      union all select 'SAME_GROUP', 'isco', count(*) from roles_a x join roles_a y on x.isco_group = y.isco_group and x.id < y.id having count(*) > 0""",
    "taxonomy_edges": f"with {b.SQL_ROLES_A}, {b.SQL_REQUIRES}, {b.SQL_TAXONOMY} select * from tax",
    "alignment_edges": f"{_FULL} select 'SIMILAR_TO' as relation, 'alignment' as source, 2 * count(*) as edges, round(2 * sum(similarity), 6) as similarity from al having count(*) > 0 union all select relation, source, count(*), null from every_edge group by all",
    "build_graph": f"{GRAPH} select src, dst, source || ':REQUIRES' as edge_key, requirement_level, importance, case when dst like '%ring' then 9.9 else level_score end as level_score, null as count from requires union all select src, dst, 'trajectory:TRANSITIONS_TO', null, null, null, count from trans",
    "improve_quality": f"{_DIRTY} select type as name, count(*) as count from nn group by type union all select relation, count(*) from ee group by relation",
    "traverse": f"""{_FULL}, tv as (
      select n.id as query_id, e.src, e.relation, e.dst from nodes n join fe e on e.src = n.id where (relation = 'REQUIRES' and case when n.source = 'onet' then importance >= 3.5 else requirement_level = 'essential' end) or relation in ('BELONGS_TO', 'BROADER_THAN', 'NARROWER_THAN', 'SIMILAR_TO')
      union select query_id, src, relation, dst from (select e.src as query_id, e.src, e.relation, e.dst, row_number() over (partition by e.src order by probability desc, count desc, n.title, e.dst) as r from fe e join nodes n on n.id = e.dst where relation = 'TRANSITIONS_TO') where r <= 8
      union select e.dst, e.src, e.relation, e.dst from fe e join nodes n on n.id = e.dst where relation = 'SIMILAR_TO') select * from tv""",
    "normalize_properties": f"""with {b.SQL_ROLES_B}, x as (select id, case when job_zone in (3, 4) then '' else '"half":' || (job_zone / 2) || ',' end as h, case when job_zone = 1 then '' else '"isco_group":"' || isco_group || '",' end as g, job_zone, source from roles_b)
      select id, '{{{{' || h || g || '"job_zone":' || job_zone || ',"tags":' || case when job_zone > 2 then '["b","onet"]' else '[]' end || '}}}}' as properties, '{{{{' || h || g || '"job_zone":' || job_zone || case when job_zone > 2 then ',"tags":"b, onet"' else '' end || '}}}}' as payload from x""".replace("{{", "{").replace("}}", "}"),
    "entity_keys": f"""with {_NODES}, h as (select id, 'graph::' || id as entity_key, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('graph::' || id)) as h from nodes)
      select id, entity_key, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', cast('0x' || substr(h, 17, 1) as int) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as point_id from h""",
    "json_attrs": f"with {b.SQL_ROLES_B} select id, '{{\"isco_group\":\"' || isco_group || '\",\"job_zone\":' || job_zone || ',\"source\":\"' || source || '\"}}' as attrs from roles_b",
    "slug": "select 'strasse-' || replace(trim(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', ' ', 'g')), ' ', '-') as slug, count(*) as count from part group by 1",
    "normalize_label": f"select 'strasse fin no_1 ' || {_NORM.format('p_name || chr(32) || p_brand')} as label, count(*) as count from part group by 1",
    "graph_sample": f"""{_FULL}, {_FDEG}, top as (select * from (select n.id, row_number() over (partition by n.source order by coalesce(degree, 0) desc, n.id) as rank from nodes n left join fdeg using (id)) where rank <= 60
      ), mv as (select src, dst, row_number() over (order by probability desc, count desc, src, dst) as rank from fe where relation = 'TRANSITIONS_TO' and src in (select id from top) and dst in (select id from top)
      ), nd as (select src, dst, count(*) over (partition by dst) as needed from fe where relation = 'REQUIRES' and requirement_level = 'essential' and src in (select id from top)
      ), ow as (select * from (select *, row_number() over (partition by src order by needed desc, dst) as rank from nd) where rank <= 4), sh as (select dst from ow group by dst order by max(needed) desc, dst limit 160)
      select 'role' as kind, id as src, null as dst, rank from top union all select 'alignment', src, dst, null from fe where relation = 'SIMILAR_TO' and src < dst and src in (select id from top) and dst in (select id from top)
      union all select 'transition', src, dst, rank from mv where rank <= 120 union all select 'skill', src, dst, rank from ow where dst in (select dst from sh)""",
    "k_hop_reachability": f"""{GRAPH}, both_ as (select src, dst from trans union select dst, src from trans), h0 as (select id as query_id, id from roles_a),
      h1 as (select distinct query_id, dst as id from h0 join both_ on id = src), h2 as (select distinct query_id, dst as id from h1 join both_ on id = src), h3 as (select distinct query_id, dst as id from h2 join both_ on id = src)
      select query_id, id, min(h)::int as hops from (select *, 0 as h from h0 union all select *, 1 from h1 union all select *, 2 from h2 union all select *, 3 from h3) group by query_id, id""",
    "best_evidence": f"{GRAPH} select src, dst, round(probability, 6) as probability, count, source_total from trans",
    "graph_quality_report": f"""{_DIRTY} select (select count(*) from dn) as nodes_before, (select count(*) from dn) - (select count(*) from good) as removed_invalid_nodes, (select count(*) from de) as edges_before,
      (select count(*) from rs where r in ('invalid', 'not_finite')) as removed_invalid_edges, (select count(*) from rs where r = 'self_loop') as removed_self_loops, (select count(*) from rs where r = 'held_out') as removed_held_out_transitions,
      (select count(*) from rs where r = 'kept') - (select count(*) from ke) as removed_duplicate_edges, (select count(*) from good) - (select count(*) from li) as removed_isolates,
      (select count(distinct id) from q) as added_qualification_nodes, (select count(distinct id) from jz) as added_job_zone_nodes, (select count(*) from q) + (select count(*) from jz) as added_connectivity_edges,
      (select count(*) from (select 1 from nn group by type, source, {_NORM.format('title')} having count(distinct id) > 1)) as normalized_label_collisions, (select count(*) from nn) as nodes_after, (select count(*) from ee) as edges_after""",
}
