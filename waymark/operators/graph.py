"""Node and edge tables: building, cleaning, auditing and enriching a typed graph."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..sources.shared import stored


def _comparison_key(text: str | None) -> str | None:
    if text is None:
        return None
    return " ".join(re.sub(r"[^\w]+", " ", unicodedata.normalize("NFKC", text).casefold()).split())


@F.pandas_udf(StringType())
def _keys(text: pd.Series) -> pd.Series:
    return text.map(_comparison_key)


def normalize_label(c: Column) -> Column:
    """Compatibility forms joined (NFKC), case folded, everything but letters, digits and underscores as single
    spaces. Spark has neither NFKC nor case folding ("ß" is "ss"), so Arrow batches go through Python; labels that
    are known to be ASCII can take `ascii_label`, which stays in the JVM and gives the same."""
    return _keys(c)


def ascii_label(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9_]+", " "))


def slug(c: Column) -> Column:
    """The label's ASCII letters and digits, joined by hyphens; "unknown" if there are none."""
    s = F.btrim(F.regexp_replace(normalize_label(c), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("unknown"))


def prefix_domain(c: Column, domains: dict[str, str]) -> Column:
    """The domain of the longest prefix that fits; else Domain- and what stands before the first point."""
    out = None
    for prefix in sorted(domains, key=lambda p: (-len(p), p)):
        hit = c.startswith(prefix)
        out = F.when(hit, domains[prefix]) if out is None else out.when(hit, domains[prefix])
    rest = F.concat(F.lit("Domain-"), F.split(c, r"\.")[0])
    return rest if out is None else out.otherwise(rest)


def relation_type(c: Column) -> Column:
    """essential or optional, from plain text or a URI; null for anything else."""
    t = F.lower(F.trim(c))
    return F.when(t.isin("essential", "optional"), t).when(t.contains("relatedessentialskill"), "essential").when(t.contains("relatedoptionalskill"), "optional")


def hierarchy_type(c: Column) -> Column:
    """BROADER_THAN or NARROWER_THAN from plain text or a URI; null for mere relatedness."""
    t = F.lower(F.trim(c))
    return F.when(t.contains("broader"), "BROADER_THAN").when(t.contains("narrower"), "NARROWER_THAN")


def finite(edges: DataFrame, scores: tuple[str, ...] = ("similarity", "probability"), counts: tuple[str, ...] = ("count",)) -> Column:
    """Scores are finite, probabilities within [0, 1], counts not negative; nulls pass."""
    ok = F.lit(True)
    for s in scores:
        ok = ok & (F.col(s).isNull() | (~F.isnan(s) & (F.abs(s) < float("inf"))))
    if "probability" in scores:
        ok = ok & (F.col("probability").isNull() | F.col("probability").between(0, 1))
    for c in counts:
        ok = ok & (F.col(c).isNull() | (F.col(c) >= 0))
    return ok


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    ids = nodes.select("id")
    return edges.join(ids, edges["src"] == ids["id"], "left_semi").join(ids, edges["dst"] == ids["id"], "left_semi")


def unique_index(nodes: DataFrame, key: str) -> DataFrame:
    """(key, id) of keys that one id has."""
    return nodes.groupBy(key).agg(F.countDistinct("id").alias("n"), F.min("id").alias("id")).filter("n = 1").drop("n")


def idf(edges: DataFrame, roles: DataFrame) -> DataFrame:
    """(dst, idf): ln of the number of roles by requiring edges; parallel edges count. roles: one row (roles)."""
    each = edges.filter("relation = 'REQUIRES'").groupBy("dst").count().crossJoin(F.broadcast(roles))
    return each.select("dst", F.log(F.col("roles") / F.col("count")).alias("idf"))


def relevant(rows: DataFrame, least: float) -> DataFrame:
    """Importance rows of `least` or more that are neither marked as not relevant nor to be suppressed; a mark that is
    missing, as a whole column or in a row, is no mark."""
    mark = lambda c: F.coalesce(F.col(c), F.lit("N")) if c in rows.columns else F.lit("N")
    return rows.filter((F.col("scale") == "IM") & (mark("not_relevant") != "Y") & (mark("suppress") != "Y") & (F.col("value") >= least))


def audit(nodes: DataFrame, edges: DataFrame, training: Column) -> DataFrame:
    """(check, name, n): isolates by type, edges with an end that is missing by relation, roles without
    requirements by source, transitions that are not finite, not for training, or to themselves, and sources
    whose probabilities add up to more than one."""
    ids = nodes.select("id").distinct()
    used = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    isolates = nodes.join(used, "id", "left_anti").groupBy(F.col("type").alias("name")).count().withColumn("check", F.lit("isolate"))
    a = edges.join(ids, edges["src"] == ids["id"], "left_anti").select("src", "dst", "relation")
    z = edges.join(ids, edges["dst"] == ids["id"], "left_anti").select("src", "dst", "relation")
    ends = a.unionByName(z).distinct().groupBy(F.col("relation").alias("name")).count().withColumn("check", F.lit("missing endpoint"))
    has = edges.filter("relation = 'REQUIRES'").select(F.col("src").alias("id")).distinct()
    poor = nodes.filter("type = 'role'").join(has, "id", "left_anti").groupBy(F.col("source").alias("name")).count().withColumn("check", F.lit("no requirements"))
    t = edges.filter("relation = 'TRANSITIONS_TO'")
    flags = F.array(F.when(~finite(t), "not finite"), F.when(~training, "held out"), F.when(F.col("src") == F.col("dst"), "self loop"))
    bad = t.select(F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("name")).groupBy("name").count().withColumn("check", F.lit("transition"))
    over = t.filter(training).groupBy("src").agg(F.sum("probability").alias("p")).filter(F.col("p") > 1 + 1e-9).agg(F.count("*").alias("count")).select(F.lit("sum over one").alias("name"), "count", F.lit("source").alias("check"))
    out = isolates
    for more in (ends, poor, bad, over):
        out = out.unionByName(more)
    return out.select("check", "name", F.col("count").alias("n"))


def sample(nodes: DataFrame, edges: DataFrame, roles: int, transitions: int, skills: int, most_skills: int) -> DataFrame:
    """(kind, src, dst, rank): roles of highest degree of each source, alignments between them, the strongest
    transitions between them, and essential skills of each, those that most of the roles need first."""
    role = nodes.filter("type = 'role'").select("id", "source").join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
    w = Window.partitionBy("source").orderBy(F.desc("degree"), "id")
    top = role.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= roles)
    inside = with_endpoints(edges, top)
    similar = inside.filter("relation = 'SIMILAR_TO' and src < dst").select(F.lit("alignment").alias("kind"), "src", "dst", F.lit(None).cast("int").alias("rank"))
    # a bounded number of rows is left when the window below numbers them
    strongest = inside.filter("relation = 'TRANSITIONS_TO'").orderBy(F.desc("probability"), F.desc("count"), "src", "dst").limit(transitions)
    moves = strongest.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("probability"), F.desc("count"), "src", "dst"))).select(F.lit("transition").alias("kind"), "src", "dst", "rank")
    ids = top.select("id")
    needs = edges.filter("relation = 'REQUIRES' and requirement_level = 'essential'").join(ids, edges["src"] == ids["id"], "left_semi").select("src", "dst")
    n = needs.groupBy("dst").agg(F.count("*").alias("needed"))
    own = needs.join(n, "dst").withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("needed"), "dst"))).filter(F.col("rank") <= skills)
    shown = own.groupBy("dst").agg(F.max("needed").alias("needed")).orderBy(F.desc("needed"), "dst").limit(most_skills).select(F.col("dst").alias("shown"))
    some = own.join(shown, own["dst"] == shown["shown"], "left_semi").select(F.lit("skill").alias("kind"), "src", "dst", "rank")
    return top.select(F.lit("role").alias("kind"), F.col("id").alias("src"), F.lit(None).cast("string").alias("dst"), "rank").unionByName(similar).unionByName(moves).unionByName(some)


def _kept(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType.typeName()
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) if kind in ("double", "float") else F.col(c)


def properties(df: DataFrame, columns: list[str]) -> Column:
    """Columns as sorted JSON, without nulls and numbers that are not finite."""
    return F.to_json(F.struct(*[_kept(df, c).alias(c) for c in sorted(columns)]))


def scalar_properties(df: DataFrame, columns: list[str]) -> Column:
    """The same with lists as text joined by ", " and empty ones left out, for stores of plain values."""
    flat = [F.nullif(F.array_join(c, ", "), F.lit("")).alias(c) if df.schema[c].dataType.typeName() == "array" else _kept(df, c).alias(c) for c in sorted(columns)]
    return F.to_json(F.struct(*flat))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) over both ends."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def dedupe(edges: DataFrame, signature: list[str], *order: Column) -> DataFrame:
    """The first edge of each signature by `order`."""
    w = Window.partitionBy(*signature).orderBy(*order)
    return edges.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def same_group_edges(roles: DataFrame, degree: DataFrame, existing: DataFrame, most: int = 20) -> DataFrame:
    """(src, dst): both directions between roles of one group; a group is cut to the `most` of highest degree."""
    d = roles.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    w = Window.partitionBy("isco_2digit").orderBy(F.desc("degree"), "id")
    top = d.filter("isco_2digit is not null").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).select("id", "isco_2digit")
    other = top.select(F.col("id").alias("dst"), F.col("isco_2digit").alias("g"))
    pairs = top.join(other, (F.col("isco_2digit") == F.col("g")) & (F.col("id") != F.col("dst"))).select(F.col("id").alias("src"), "dst")
    return pairs.join(existing.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def prune(nodes: DataFrame, edges: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Without roles of fewer than `least` requirements, then without nodes that no edge has."""
    n = edges.filter("relation = 'REQUIRES'").groupBy(F.col("src").alias("id")).count()
    poor = nodes.filter("type = 'role'").join(n, "id", "left").filter(F.coalesce("count", F.lit(0)) < least).select("id")
    kept = edges.join(poor, edges["src"] == poor["id"], "left_anti").join(poor, edges["dst"] == poor["id"], "left_anti")
    used = kept.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes.join(poor, "id", "left_anti").join(used, "id", "left_semi"), kept


def derived_entities(nodes: DataFrame, column: str, title: Column, prefix: str, kind: str, relation: str) -> tuple[DataFrame, DataFrame]:
    """Nodes for the values of a column of roles of the second source, one a key with the first role's title,
    and edges to them."""
    value = F.trim(F.col(column).cast("string"))
    has = nodes.filter((F.col("type") == "role") & (F.col("source") == "onet") & (value != "")).withColumn("key", F.concat(F.lit(prefix), slug(value)))
    made = has.groupBy(F.col("key").alias("id")).agg(F.min_by(title, "id").alias("title")).select("id", F.lit(kind).alias("type"), F.lit("onet").alias("source"), "title")
    return made, has.select(F.col("id").alias("src"), F.col("key").alias("dst"), F.lit(relation).alias("relation"), F.lit("onet").alias("source"))


def uuid5(name: Column, namespace: str = "6ba7b8109dad11d180b400c04fd430c8") -> Column:
    """UUID version 5 of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def reach(edges: DataFrame, starts: DataFrame, hops: int = 3) -> DataFrame:
    """(query_id, id, hops): nodes within `hops` undirected steps of a query's starts, with the least number."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = starts.select("query_id", "id").distinct().withColumn("hops", F.lit(0))
    edge = seen
    for i in range(1, hops + 1):
        step = edge.join(both, edge["id"] == both["src"]).select("query_id", F.col("dst").alias("id")).distinct()
        edge = step.join(seen, ["query_id", "id"], "left_anti").withColumn("hops", F.lit(i))
        seen = seen.unionByName(edge)
    return seen


def reached(edges: DataFrame, starts: DataFrame, ends: DataFrame, hops: int = 3) -> DataFrame:
    """(query_id, id): those of a query's ends within `hops` undirected steps of one of its starts, both (query_id, id).

    Each pair that is asked for is looked at once, whatever the number of queries, and walked for only until it has met:
    nodes come from the starts of pairs that are left, and of the last step only edges into their ends are looked up."""
    start, end = starts.select("query_id", F.col("id").alias("start")), ends.select("query_id", F.col("id").alias("end"))
    asked = start.distinct().join(end.distinct(), "query_id").filter("start is not null and end is not null")
    pairs = stored(asked.select("start", "end").distinct(), "asked-pairs")
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    left, met = pairs.filter("start <> end"), pairs.filter("start = end")
    front = left.select("start", F.col("start").alias("src")).distinct()
    for i in range(hops):
        if left.isEmpty():
            break
        if i:
            # one step on from what is new, for starts that still lack an end
            step = front.join(left.select("start").distinct(), "start", "left_semi").join(both, "src").select("start", F.col("dst").alias("src")).distinct()
            front = stored(step.join(seen, ["start", "src"], "left_anti"), "front")
        seen = seen.unionByName(front) if i else front
        last = both.join(left.select(F.col("end").alias("dst")).distinct(), "dst", "left_semi").join(front.select("src").distinct(), "src", "left_semi").select("src", F.col("dst").alias("end")).distinct()
        hit = stored(front.join(last, "src").select("start", "end").distinct().join(left, ["start", "end"], "left_semi"), "met")
        met, left = met.unionByName(hit), stored(left.join(hit, ["start", "end"], "left_anti"), "left-pairs")
    return asked.join(met, ["start", "end"], "left_semi").select("query_id", F.col("end").alias("id")).distinct()


# What a cleaned graph may hold.
NODE_TYPES = ("role", "skill", "element", "isco_group", "skill_group", "qualification", "job_zone")
RELATIONS = ("REQUIRES", "BELONGS_TO", "BROADER_THAN", "NARROWER_THAN", "SIMILAR_TO", "TRANSITIONS_TO", "ISCO_NEIGHBOUR", "TYPICALLY_REQUIRES_QUALIFICATION", "IN_JOB_ZONE")


def build(frames: list[DataFrame], edges: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of several sources as one graph.

    A node that several frames name, and an edge of one (src, dst, source:relation), are one; of each attribute
    the last frame's value that is there counts. Edges without both ends go."""

    def merged(parts: list[DataFrame], keys: list[str]) -> DataFrame:
        every = None
        for i, df in enumerate(parts):
            one = df.withColumn("seq", F.lit(i))
            every = one if every is None else every.unionByName(one, allowMissingColumns=True)
        rest = [c for c in every.columns if c not in (*keys, "seq")]
        return every.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in rest])

    nodes = merged(frames, ["id"])
    keyed = [e.withColumn("edge_key", F.concat_ws(":", F.coalesce("source", F.lit("unknown")), F.coalesce("relation", F.lit("UNKNOWN")))) for e in edges]
    return nodes, with_endpoints(merged(keyed, ["src", "dst", "edge_key"]), nodes)


def both_ways(broader: DataFrame, pillar: str | None = None) -> DataFrame:
    """(src, dst, relation, source, pillar) in both directions of (id, broader)."""
    up = broader.select(F.col("id").alias("src"), F.col("broader").alias("dst"), F.lit("BROADER_THAN").alias("relation"))
    down = broader.select(F.col("broader").alias("src"), F.col("id").alias("dst"), F.lit("NARROWER_THAN").alias("relation"))
    return up.unionByName(down).select("src", "dst", "relation", F.lit("esco").alias("source"), F.lit(pillar).cast("string").alias("pillar"))


def requirement_edges(relations: DataFrame) -> DataFrame:
    """REQUIRES edges of (role, skill, relation_type)."""
    e = relations.withColumn("requirement_level", relation_type(F.col("relation_type"))).filter("requirement_level is not null")
    return e.select(F.col("role").alias("src"), F.col("skill").alias("dst"), F.lit("REQUIRES").alias("relation"), F.lit("esco").alias("source"), F.lit(None).cast("string").alias("pillar"), "requirement_level")


def membership_edges(roles: DataFrame, groups: DataFrame) -> DataFrame:
    """BELONGS_TO edges of roles (id, isco_group) to the groups (code, group_id) of their codes."""
    g = groups.select(F.trim("code").alias("code"), "group_id")
    j = roles.join(g, F.trim("isco_group") == g["code"])
    return j.select(F.col("id").alias("src"), F.col("group_id").alias("dst"), F.lit("BELONGS_TO").alias("relation"), F.lit("esco").alias("source"), F.lit(None).cast("string").alias("pillar"))


def level_edges(hierarchy: DataFrame, levels: list[str]) -> DataFrame:
    """Edges both ways between neighbouring level columns, where both are there and differ."""
    pair = F.array(*[F.struct(F.trim(c).alias("id"), F.trim(p).alias("broader")) for p, c in zip(levels, levels[1:], strict=False)])
    pairs = hierarchy.select(F.explode(pair).alias("x")).select("x.id", "x.broader").filter("id <> '' and broader <> '' and id <> broader").distinct()
    return both_ways(pairs, "skills")


def skill_relation_edges(relations: DataFrame) -> DataFrame:
    """Hierarchy edges of (skill, other, relation_type); mere relatedness is left out."""
    e = relations.withColumn("relation", hierarchy_type(F.col("relation_type"))).filter("relation is not null")
    return e.select(F.col("skill").alias("src"), F.col("other").alias("dst"), "relation", F.lit("esco").alias("source"), F.lit("skills").alias("pillar"))


def replaced(edges: DataFrame, kind: Column, new: DataFrame) -> DataFrame:
    """`edges` with those of one kind replaced by `new`."""
    return edges.filter(~F.coalesce(kind, F.lit(False))).unionByName(new, allowMissingColumns=True)


def alignment_edges(edges: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """`edges` with its alignment replaced by both directions of `pairs` (id, nbr, similarity) of known nodes."""
    one = pairs.select(F.col("id").alias("src"), F.col("nbr").alias("dst"), "similarity")
    two = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "similarity"))
    known = with_endpoints(two, nodes).withColumn("relation", F.lit("SIMILAR_TO")).withColumn("source", F.lit("alignment"))
    return replaced(edges, (F.col("relation") == "SIMILAR_TO") & (F.col("source") == "alignment"), known)


SCORES = ("probability", "similarity", "importance", "level_score")


def staged_nodes(nodes: DataFrame) -> DataFrame:
    """nodes, cleaned, with ok: whether id, title and an allowed type are there."""
    t = F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"\s+", " "))
    n = nodes.withColumn("id", F.trim("id")).withColumn("type", F.trim("type")).withColumn("title", t)
    return n.withColumn("ok", (F.coalesce("id", F.lit("")) != "") & F.coalesce(F.col("type").isin(*NODE_TYPES), F.lit(False)) & (F.col("title") != ""))


def staged_edges(edges: DataFrame, nodes: DataFrame, training: Column) -> DataFrame:
    """edges with reason, the first that holds: invalid (no such end or relation), self_loop, held_out, not_finite,
    duplicate (not the preferred one of its src, dst, relation and source), kept. nodes: (id), the good ones;
    training: whether a transition may be used."""
    ids = nodes.select("id").distinct()
    a, z = ids.select(F.col("id").alias("_a"), F.lit(True).alias("_src")), ids.select(F.col("id").alias("_z"), F.lit(True).alias("_dst"))
    e = edges.withColumn("relation", F.upper(F.trim("relation"))).withColumn("source", F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("derived")))
    e = e.join(a, e["src"] == a["_a"], "left").join(z, e["dst"] == z["_z"], "left")
    bad_end = F.col("_src").isNull() | F.col("_dst").isNull() | ~F.coalesce(F.col("relation").isin(*RELATIONS), F.lit(False))
    first = (
        F.when(bad_end, "invalid").when(F.col("src") == F.col("dst"), "self_loop").when((F.col("relation") == "TRANSITIONS_TO") & ~training, "held_out")
        .when(~finite(edges, SCORES, ("count", "source_total")), "not_finite").otherwise("kept")
    )
    columns = sorted(edges.columns)
    e = e.withColumn("reason", F.coalesce(first, F.lit("invalid"))).drop("_a", "_z", "_src", "_dst")
    order = [F.desc(F.coalesce(F.lower("requirement_level") == "essential", F.lit(False))), *[F.desc(F.coalesce(c, F.lit(0))) for c in ("count", "probability", "similarity")], F.desc(F.to_json(F.struct(*columns)))]
    w = Window.partitionBy("src", "dst", "relation", "source", F.col("reason") == "kept").orderBy(*order)
    return e.withColumn("_n", F.row_number().over(w)).withColumn("reason", F.when((F.col("reason") == "kept") & (F.col("_n") > 1), "duplicate").otherwise(F.col("reason"))).drop("_n")


def improve(nodes: DataFrame, edges: DataFrame, training: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, report): the graph without invalid nodes, invalid, looping, held-out, non-finite and
    duplicate edges and isolates, with qualifications and job zones of roles added as nodes.

    report: one row of counters of what went and what came. Pass stored tables: each is read several times."""
    n, e = staged_nodes(nodes), None
    good = n.filter("ok").drop("ok").dropDuplicates(["id"])
    e = stored(staged_edges(edges, good, training), "judged-edges")  # joined and sorted once, whatever reads it
    kept = e.filter("reason = 'kept'").drop("reason")
    used = kept.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    linked = stored(good.join(used, "id", "left_semi"), "linked-nodes")
    zone = F.coalesce(F.nullif(F.trim("job_zone_title"), F.lit("")), F.concat(F.lit("Job Zone "), F.trim(F.col("job_zone").cast("string"))))
    q, qe = derived_entities(linked, "typical_education_level", F.trim("typical_education_level"), "derived:qualification:", "qualification", "TYPICALLY_REQUIRES_QUALIFICATION")
    j, je = derived_entities(linked, "job_zone", zone, "derived:job-zone:", "job_zone", "IN_JOB_ZONE")
    out_nodes = linked.unionByName(q, allowMissingColumns=True).unionByName(j, allowMissingColumns=True)
    out_edges = kept.unionByName(qe, allowMissingColumns=True).unionByName(je, allowMissingColumns=True)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    of = lambda reason, name: F.count_if(F.col("reason").isin(*reason)).alias(name)
    collisions = out_nodes.groupBy("type", "source", normalize_label(F.col("title")).alias("key")).agg(F.countDistinct("id").alias("n")).filter("n > 1 and key <> ''")
    report = n.agg(F.count("*").alias("nodes_before"), F.count_if(~F.col("ok")).alias("removed_invalid_nodes"))
    for more in (
        e.agg(F.count("*").alias("edges_before"), of(("invalid", "not_finite"), "removed_invalid_edges"), of(("self_loop",), "removed_self_loops"), of(("held_out",), "removed_held_out_transitions"), of(("duplicate",), "removed_duplicate_edges")),
        count(good.join(used, "id", "left_anti"), "removed_isolates"), count(q, "added_qualification_nodes"), count(j, "added_job_zone_nodes"), count(qe.unionByName(je), "added_connectivity_edges"),
        count(collisions, "normalized_label_collisions"), count(out_nodes, "nodes_after"), count(out_edges, "edges_after"),
    ):
        report = report.crossJoin(more)  # one row each
    return out_nodes, out_edges, report


def traverse(anchors: DataFrame, nodes: DataFrame, edges: DataFrame, training: Column, least: float = 3.5, transitions: int = 8) -> DataFrame:
    """(query_id, src, relation, dst) around anchors (query_id, id): requirements that count (essential, or of
    `least` importance for roles of the second source), hierarchy and alignment out of an anchor, alignment
    into it, and its strongest training transitions."""
    return around(anchors, surroundings(anchors.select("id").distinct(), nodes, edges, training, least, transitions))


def surroundings(ids: DataFrame, nodes: DataFrame, edges: DataFrame, training: Column, least: float = 3.5, transitions: int = 8) -> DataFrame:
    """(anchor, src, relation, dst, into, again): what `traverse` finds around each of `ids` (id), whatever queries ask for it; into:
    whether an edge only leads to the anchor; again: whether it leads out of its src, too, where that is an anchor."""
    a = ids.select(F.col("id").alias("anchor")).distinct().join(nodes.select(F.col("id").alias("anchor"), F.col("source").alias("of"), "title"), "anchor")
    e = edges.withColumn("usable", training)
    out = a.join(e, a["anchor"] == e["src"])
    needs = (F.col("relation") == "REQUIRES") & F.when(F.col("of") == "onet", F.col("importance") >= least).otherwise(F.col("requirement_level") == "essential")
    plain = out.filter(F.coalesce(needs, F.lit(False)) | F.col("relation").isin("BELONGS_TO", "BROADER_THAN", "NARROWER_THAN", "SIMILAR_TO")).select("anchor", "src", "relation", "dst")
    titles = nodes.select(F.col("id").alias("dst"), F.col("title").alias("dst_title"))
    w = Window.partitionBy("src").orderBy(F.desc(F.coalesce("probability", F.lit(0.0))), F.desc(F.coalesce("count", F.lit(0))), F.coalesce("dst_title", "dst"), "dst")
    moves = out.filter("usable").join(titles, "dst", "left").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= transitions).select("anchor", "src", "relation", "dst")
    known = nodes.select(F.col("id").alias("src"), F.lit(True).alias("known")).distinct()
    into = a.join(e.filter("relation = 'SIMILAR_TO'"), a["anchor"] == F.col("dst")).select("anchor", "src", "relation", "dst").distinct()
    into = into.join(known, "src", "left").select("anchor", "src", "relation", "dst", F.lit(True).alias("into"), F.col("known").isNotNull().alias("again"))
    return plain.unionByName(moves).distinct().withColumn("into", F.lit(False)).withColumn("again", F.lit(False)).unionByName(into)


def around(anchors: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, src, relation, dst): the surroundings of each query's anchors (query_id, id), each triple once.

    Those out of an anchor are a query's only once; one into it is left out where it also leads out of another
    anchor of the query. A query's anchors are a list beside each of them, so triples are made once and never shuffled."""
    lists = anchors.groupBy("query_id").agg(F.collect_set("id").alias("all"))
    each = stored(lists.select("query_id", "all", F.explode("all").alias("anchor")).sortWithinPartitions("anchor"), "anchors")
    return each.join(found, "anchor").filter(~(F.col("again") & F.array_contains("all", F.col("src")))).select("query_id", "src", "relation", "dst")


# Relation of a candidate's evidence in a trace.
EVIDENCE = {"neighbour_transition": "SEMANTIC_TRANSITION_BACKOFF", "predicted_transition": "PREDICTED_TRANSITION"}


def evidence_triples(triples: DataFrame, candidates: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """triples with one more for each candidate (query_id, current, id, evidence_type) that has evidence; a
    direct transition that is there already is not doubled.

    known: the surroundings that triples are made from, if each current role is an anchor of its query: its own
    say what is there already, and the triples of all queries are not made again to look that up."""
    kind = F.create_map(*[F.lit(x) for pair in EVIDENCE.items() for x in pair])[F.col("evidence_type")]
    more = candidates.filter("evidence_type is not null and current is not null").select("query_id", F.col("current").alias("src"), F.coalesce(kind, F.lit("TRANSITIONS_TO")).alias("relation"), F.col("id").alias("dst"))
    by = ["src", "relation", "dst"] if known is not None else ["query_id", "src", "relation", "dst"]
    # only triples of these relations can be there already
    same = (triples if known is None else known).filter(F.col("relation").isin("TRANSITIONS_TO", *EVIDENCE.values())).select(*by)
    return triples.unionByName(more.distinct().join(same, by, "left_anti"))
