"""Skill gaps, effort, retrieval and fusion over requirement, transition and ranking tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strongest(pairs: DataFrame) -> DataFrame:
    """(id, partner, similarity): each id's most similar partner, of either end; ties to the greater partner."""
    both = pairs.select("id", F.col("nbr").alias("partner"), "similarity").union(pairs.select(F.col("nbr"), F.col("id"), "similarity"))
    return both.groupBy("id").agg(F.max(F.struct("similarity", "partner")).alias("m")).select("id", "m.partner", "m.similarity")


#: Where a role's requirements come from, or why it has none.
STATUSES = ("direct_esco", "aligned_esco", "direct_onet", "no_requirements", "no_esco_alignment", "unsupported_role_source")


def requirement_evidence(nodes: DataFrame, aligned: DataFrame) -> DataFrame:
    """(role, origin, evidence): the role whose skills stand for each role's: itself, or the one it is aligned with.

    A role of the second source that is aligned never falls back to its own skills, even if its partner has none.
    nodes: (id, source); aligned: (id, partner)."""
    j = nodes.select(F.col("id").alias("role"), "source").join(aligned.select(F.col("id").alias("role"), "partner"), "role", "left")
    via = F.col("partner").isNotNull()
    origin = F.when(F.col("source") == "esco", "direct_esco").when((F.col("source") == "onet") & via, "aligned_esco").when(F.col("source") == "onet", "direct_onet").otherwise("unsupported_role_source")
    return j.select("role", origin.alias("origin"), F.when(origin == "aligned_esco", F.col("partner")).when(origin != "unsupported_role_source", F.col("role")).alias("evidence"))


def role_requirements(nodes: DataFrame, requires: DataFrame, aligned: DataFrame, least: float = 3.5) -> DataFrame:
    """(role, skill, status, evidence): essential skills of roles of the first source; for others those of the aligned role,
    or, where there is no such role, their own of at least `least` importance. Roles without a skill have no row."""
    essential = requires.filter("source = 'esco' and requirement_level = 'essential'").select(F.col("src").alias("evidence"), F.col("dst").alias("skill"))
    own = requires.filter((F.col("source") == "onet") & (F.col("importance") >= least)).select(F.col("src").alias("evidence"), F.col("dst").alias("skill"))
    e = requirement_evidence(nodes, aligned)
    first = e.filter("origin in ('direct_esco', 'aligned_esco')").join(essential, "evidence")
    second = e.filter("origin = 'direct_onet'").join(own, "evidence")
    return first.unionByName(second).select("role", "skill", F.col("origin").alias("status"), "evidence")


def requirement_status(nodes: DataFrame, aligned: DataFrame, requirements: DataFrame) -> DataFrame:
    """(role, status, evidence, skills) of every role: how many skills it needs, on what evidence, and why if none."""
    n = requirements.groupBy("role").agg(F.count("*").alias("skills"))
    none = F.when(F.col("origin") == "direct_onet", "no_esco_alignment").when(F.col("origin") == "unsupported_role_source", F.col("origin")).otherwise("no_requirements")
    return requirement_evidence(nodes, aligned).join(n, "role", "left").select("role", F.when(F.col("skills") > 0, F.col("origin")).otherwise(none).alias("status"), "evidence", F.coalesce("skills", F.lit(0)).alias("skills"))


def need_lists(requirements: DataFrame, idf: DataFrame) -> DataFrame:
    """(role, needs): each role's required skills with their idf, 1 where that is unknown, as one list."""
    need = requirements.join(idf.select(F.col("dst").alias("skill"), "idf"), "skill", "left")
    return need.groupBy("role").agg(F.collect_list(F.struct("skill", F.coalesce("idf", F.lit(1.0)).alias("idf"))).alias("needs"))


def gaps(targets: DataFrame, requirements: DataFrame, owned: DataFrame, idf: DataFrame) -> DataFrame:
    """(query_id, role, required, owned, accessibility, qualification) for `targets` (query_id, role).

    accessibility is the idf share of the required skills that the query owns, null for a query that
    owns nothing known; qualification is the same with 0 for unknown, to four places."""
    return gaps_of_lists(targets, need_lists(requirements, idf), owned)


def gaps_of_lists(targets: DataFrame, needs: DataFrame, owned: DataFrame) -> DataFrame:
    """gaps by roles' lists (role, needs). What a query owns is a list beside its targets, so a target is one row from
    end to end, and neither its skills nor the lists of two queries are ever shuffled."""
    own = owned.groupBy("query_id").agg(F.collect_set("skill").alias("own"))
    asked = targets.groupBy("query_id").agg(F.collect_set("role").alias("roles"))
    each = asked.join(own.hint("merge"), "query_id", "left").select("query_id", "own", F.explode("roles").alias("role")).join(needs, "role")
    total = lambda skills: F.aggregate(skills, F.lit(0.0), lambda a, x: a + x["idf"])
    none = F.array().cast(needs.schema["needs"].dataType)
    has = each.withColumn("has", F.coalesce(F.filter("needs", lambda x: F.array_contains("own", x["skill"])), none))
    out = has.select("query_id", "role", "own", F.size("needs").cast("long").alias("required"), F.size("has").cast("long").alias("owned"), total(F.col("needs")).alias("all"), total(F.col("has")).alias("got"))
    share = F.when(F.col("own").isNotNull() & (F.col("all") > 0), F.col("got") / F.col("all"))
    return out.select("query_id", "role", "required", "owned", share.alias("accessibility"), F.round(F.coalesce(share, F.lit(0.0)) + 1e-12, 4).alias("qualification"))


def overlaps(owned: DataFrame, requirements: DataFrame, idf: DataFrame, top: int = 20) -> DataFrame:
    """(query_id, role, score, rank): roles by the idf share of their skills that a query owns, the `top` best.

    Owned skills meet requirements on the skill, so roles without an overlap never appear; a role's whole is
    summed up once."""
    need = requirements.join(idf.select(F.col("dst").alias("skill"), "idf"), "skill", "left").select("role", "skill", F.coalesce("idf", F.lit(1.0)).alias("idf"))
    whole = need.groupBy("role").agg(F.sum("idf").alias("all"))
    got = owned.select("query_id", "skill").join(need, "skill").groupBy("query_id", "role").agg(F.sum("idf").alias("got")).join(whole, "role")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "role")
    return got.select("query_id", "role", F.round(F.col("got") / F.col("all"), 9).alias("score")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def hybrid(lists: DataFrame, evidence: DataFrame, predicted: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, id, score, sources, evidence_type, rank): reciprocal-rank fusion of ranked lists
    (query_id, list, id, rank), filled up by predictions (query_id, id, rank).

    A prediction adds its name to a candidate that is there, and its evidence if that has none; others come behind
    all fused ones with score 0, or by their own ranks where a query has no list at all. evidence:
    (query_id, id, evidence_type) of the transition list."""
    fused = lists.groupBy("query_id", "id").agg(F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias("score"), F.collect_set("list").alias("sources"))
    fused = fused.join(evidence.select("query_id", "id", "evidence_type"), ["query_id", "id"], "left")
    more = predicted.select("query_id", "id", F.col("rank").alias("place"))
    some = fused.select("query_id").distinct().withColumn("some", F.lit(True))
    both = fused.join(more, ["query_id", "id"], "full").join(some, "query_id", "left")
    alone = F.col("score").isNull()
    score = F.when(~alone, F.round("score", 9)).when(F.col("some"), 0.0).otherwise(F.round(1 / (F.lit(float(k)) + F.col("place")), 9))
    names = F.array_join(F.array_sort(F.concat(F.coalesce("sources", F.array().cast("array<string>")), F.when(F.col("place").isNotNull(), F.array(F.lit("predicted"))).otherwise(F.array().cast("array<string>")))), ",")
    kind = F.coalesce("evidence_type", F.when(F.col("place").isNotNull(), "predicted_transition"))
    w = Window.partitionBy("query_id").orderBy("alone", F.desc("score"), F.when(F.col("alone"), F.col("place")), "id")
    out = both.select("query_id", "id", score.alias("score"), names.alias("sources"), kind.alias("evidence_type"), alone.alias("alone"), "place")
    return out.withColumn("rank", F.row_number().over(w)).select("query_id", "id", "score", "sources", "evidence_type", "rank")


def rank_by_gap(candidates: DataFrame) -> DataFrame:
    """candidates with place, their order within a query: known accessibility first, the more accessible, direct then
    backed-off transitions, the stronger, the more often seen, the better score, title and id.

    candidates: (query_id, id, title, accessibility, evidence_type, strength, count, score). If no candidate
    of a query has an accessibility, that says nothing about any."""
    q = Window.partitionBy("query_id")
    some = F.max(F.col("accessibility").isNotNull()).over(q)
    bucket = F.when(F.col("evidence_type") == "direct_transition", 0).when(F.col("evidence_type") == "neighbour_transition", 1).otherwise(2)
    c = candidates.withColumn("some", some).withColumn("bucket", bucket)
    keys = [
        F.when(F.col("some") & F.col("accessibility").isNull(), 1).otherwise(0), F.when(F.col("some"), -F.coalesce("accessibility", F.lit(-1.0))).otherwise(0.0), F.col("bucket"),
        -F.when(F.col("bucket") < 2, F.coalesce("strength", F.lit(0.0))).otherwise(0.0), -F.coalesce("count", F.lit(0)), -F.coalesce("score", F.lit(0.0)), F.col("title"), F.col("id"),
    ]
    return c.withColumn("place", F.row_number().over(q.orderBy(*keys))).drop("some", "bucket")


def gap_skills(targets: DataFrame, requirements: DataFrame, owned: DataFrame, idf: DataFrame) -> DataFrame:
    """(query_id, role, kind, skill, idf, share, rank): of each target the eight rarest missing skills (priority) with
    their share of all its idf, the three rarest of them (blocker), and the five rarest owned ones (quick win)."""
    need = requirements.join(idf.select(F.col("dst").alias("skill"), "idf"), "skill", "left").withColumn("idf", F.round(F.coalesce("idf", F.lit(1.0)), 9))
    j = targets.select("query_id", "role").join(need, "role").join(owned.select("query_id", "skill", F.lit(True).alias("has")).hint("merge"), ["query_id", "skill"], "left")
    j = j.withColumn("has", F.col("has").isNotNull()).withColumn("all", F.sum("idf").over(Window.partitionBy("query_id", "role")))
    w = Window.partitionBy("query_id", "role", "has").orderBy(F.desc("idf"), "skill")
    r = j.withColumn("rank", F.row_number().over(w))
    kinds = F.when(F.col("has"), F.when(F.col("rank") <= 5, F.array(F.lit("quick win")))).when(F.col("rank") <= 3, F.array(F.lit("priority"), F.lit("blocker"))).when(F.col("rank") <= 8, F.array(F.lit("priority")))
    return r.select("query_id", "role", F.explode(kinds).alias("kind"), "skill", "idf", F.round(F.col("idf") / F.col("all"), 4).alias("share"), "rank")


def best_courses(skills: DataFrame, courses: DataFrame) -> DataFrame:
    """(skill, course, title): of each skill (skill, words) the course (course, title, words) that shares most words
    with it, the first by id of equals; skills that share none with any have no row."""
    a = skills.select("skill", F.explode(F.array_distinct("words")).alias("word"))
    z = courses.select("course", "title", F.explode(F.array_distinct("words")).alias("word"))
    n = a.join(z, "word").groupBy("skill", "course", "title").agg(F.count("*").alias("n"))
    first = F.min(F.struct((-F.col("n")).alias("n"), "course", "title"))
    return n.groupBy("skill").agg(first.alias("m")).select("skill", "m.course", "m.title")


def learning_plan(priorities: DataFrame, weeks: DataFrame, courses: DataFrame, size: int = 3) -> DataFrame:
    """(query_id, role, phase, week_start, week_end, weeks_to_ready, focus, skills, courses): priority skills in
    phases of `size`, each of equal length, with two courses at most.

    priorities: (query_id, role, skill, rank); weeks: (query_id, role, weeks_low, weeks_high); courses: (skill, title)."""
    named = priorities.join(courses.select("skill", "title"), "skill", "left").withColumn("phase", (F.floor((F.col("rank") - 1) / size) + 1).cast("int"))
    by = named.groupBy("query_id", "role", "phase").agg(F.array_sort(F.collect_list(F.struct("rank", "skill", "title"))).alias("x"))
    total = by.groupBy("query_id", "role").agg(F.count("*").cast("int").alias("phases"))
    j = by.join(total, ["query_id", "role"]).join(weeks, ["query_id", "role"], "left")
    all_ = F.floor((F.coalesce("weeks_low", F.lit(0)) + F.coalesce("weeks_high", F.lit(0))) / 2).cast("int")
    j = j.withColumn("total", all_).withColumn("per", F.when(F.col("total") > 0, F.greatest(F.lit(2), F.floor(F.col("total") / F.col("phases")).cast("int"))).otherwise(4))
    titles = F.slice(F.array_distinct(F.filter(F.transform("x", lambda y: y["title"]), lambda t: t.isNotNull())), 1, 2)
    return j.select(
        "query_id", "role", "phase", (1 + (F.col("phase") - 1) * F.col("per")).alias("week_start"), (F.col("phase") * F.col("per")).alias("week_end"), F.when(F.col("total") > 0, F.col("total")).otherwise(4 * F.col("phases")).alias("weeks_to_ready"),
        F.col("x")[0]["skill"].alias("focus"), F.array_join(F.transform("x", lambda y: y["skill"]), "|").alias("skills"), F.array_join(titles, "|").alias("courses"),
    )


def path_skills(shown: DataFrame, requirements: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, skill, n): skills beside the roles shown to each query (query_id, role): the most shared first, taken
    while one of its roles has fewer than `most`. A choice depends on those before it, but on nothing of a query
    but its few roles, so it is made once for each set of roles and joined to the queries that have it."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for key, roles in zip(batch.column("roles").to_pylist(), batch.column("x").to_pylist(), strict=True):
                by: dict[str, set] = {}
                for role in roles:
                    for skill in role["skills"]:
                        by.setdefault(skill, set()).add(role["role"])
                count: dict[str, int] = {}
                for skill, having in sorted(by.items(), key=lambda x: (-len(x[1]), x[0])):
                    free = [r for r in having if count.get(r, 0) < most]
                    for r in free:
                        count[r] = count.get(r, 0) + 1
                    if free:
                        for column, value in zip(out, (key, skill, len(having)), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.list_(pa.string())), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["roles", "skill", "n"])

    sets = shown.groupBy("query_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    lists = requirements.groupBy("role").agg(F.collect_set("skill").alias("skills"))
    each = sets.select("roles").distinct().select("roles", F.explode("roles").alias("role")).join(lists, "role")
    chosen = each.groupBy("roles").agg(F.collect_list(F.struct("role", "skills")).alias("x")).mapInArrow(walk, "roles array<string>, skill string, n long")
    return sets.join(chosen, "roles").select("query_id", "skill", "n")


def explain(pairs: DataFrame, transitions: DataFrame, aligned: DataFrame, requirements: DataFrame, owned: DataFrame) -> DataFrame:
    """(query_id, target, step, relation, other, value, count, status): why a target follows a query's current role.

    pairs: (query_id, current, target, evidence_type, strength). Evidence that is no edge comes first (step 0),
    then the strongest transition between the two (1), the strongest alignment of the target (2), three skills that both
    roles need and the query owns (3) and three that it lacks (4), by id."""
    blank = [F.lit(None).cast("double").alias("value"), F.lit(None).cast("long").alias("count")]
    virtual = pairs.filter("evidence_type in ('neighbour_transition', 'predicted_transition')").select(
        "query_id", "target", F.lit(0).alias("step"), F.when(F.col("evidence_type") == "neighbour_transition", "SEMANTIC_TRANSITION_BACKOFF").otherwise("PREDICTED_TRANSITION").alias("relation"), F.col("target").alias("other"),
        F.round(F.coalesce("strength", F.lit(0.0)), 4).alias("value"), F.lit(None).cast("long").alias("count"), F.lit(None).cast("string").alias("status"),
    )
    p = pairs.select("query_id", "current", "target")
    best = transitions.groupBy(F.col("src").alias("current"), F.col("dst").alias("target")).agg(F.max(F.struct("probability", "count")).alias("m"))
    moved = p.join(best, ["current", "target"]).select("query_id", "target", F.lit(1).alias("step"), F.lit("TRANSITIONS_TO").alias("relation"), F.col("target").alias("other"), F.round("m.probability", 4).alias("value"), F.col("m.count").alias("count"), F.lit(None).cast("string").alias("status"))
    like = p.join(aligned.select(F.col("id").alias("target"), "partner", "similarity"), "target").select("query_id", "target", F.lit(2).alias("step"), F.lit("SIMILAR_TO").alias("relation"), F.col("partner").alias("other"), F.round("similarity", 4).alias("value"), F.lit(None).cast("long").alias("count"), F.lit(None).cast("string").alias("status"))
    need = p.join(requirements.select(F.col("role").alias("target"), "skill"), "target").join(owned.select("query_id", "skill", F.lit(True).alias("has")).hint("merge"), ["query_id", "skill"], "left")
    both = need.join(requirements.select(F.col("role").alias("current"), "skill", F.lit(True).alias("mine")), ["current", "skill"], "left")
    step = F.when(F.col("has") & F.col("mine"), 3).when(F.col("has").isNull(), 4)
    n = F.row_number().over(Window.partitionBy("query_id", "target", "step").orderBy("skill"))
    skills = both.withColumn("step", step).filter("step is not null").withColumn("n", n).filter("n <= 3")
    skills = skills.select("query_id", "target", "step", F.lit("REQUIRES").alias("relation"), F.col("skill").alias("other"), *blank, F.when(F.col("step") == 3, "you_have_this").otherwise("you_need_this").alias("status"))
    return virtual.unionByName(moved).unionByName(like).unionByName(skills)


def format_steps(steps: DataFrame) -> DataFrame:
    """(query_id, target, explanation): a line a step, in order."""
    text = (
        F.when(F.col("relation") == "TRANSITIONS_TO", F.format_string("  -> TRANSITIONS_TO (%.2f%%, n=%d) -> %s", F.round(F.col("value") * 100, 2), "count", "other"))
        .when(F.col("relation") == "SIMILAR_TO", F.format_string("  -> SIMILAR_TO (%.2f) -> %s", F.round("value", 2), "other"))
        .when(F.col("relation") == "PREDICTED_TRANSITION", F.format_string("  -> PREDICTED_TRANSITION (model score %.2f%%) -> %s", F.round(F.col("value") * 100, 2), "other"))
        .when(F.col("relation") == "SEMANTIC_TRANSITION_BACKOFF", F.format_string("  -> SEMANTIC_TRANSITION_BACKOFF (%.2f) -> %s", F.round("value", 2), "other"))
        .otherwise(F.concat(F.lit("  -> REQUIRES -> "), "other", F.when(F.col("status") == "you_have_this", " (you already have this)").otherwise(" (you need this)")))
    )
    lines = F.transform(F.array_sort(F.collect_list(F.struct("step", "other", text.alias("line")))), lambda x: x["line"])
    return steps.groupBy("query_id", "target").agg(F.array_join(lines, "\n").alias("explanation"))


def group_distance(a: Column, b: Column) -> Column:
    """1 minus the share of leading digits in common, 0 for equal codes, null if one is missing."""
    n = F.least(F.lit(4), F.greatest(F.length(a), F.length(b)))
    same = F.lit(0)
    for k in (1, 2, 3, 4):
        same = F.when((F.substring(a, 1, k) == F.substring(b, 1, k)) & (F.length(a) >= k) & (F.length(b) >= k), k).otherwise(same)
    return F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, 0.0).otherwise(1 - same / n))


def step_distance(a: Column, b: Column) -> Column:
    """0 for equal groups, 1/2 for groups whose numbers are within five or of which one is missing, else 1."""
    x, y = a.try_cast("int"), b.try_cast("int")
    return F.when(x.isNull() | y.isNull(), 0.5).when(x == y, 0.0).when(F.abs(x - y) <= 5, 0.5).otherwise(1.0)


def scaled_distance(a: Column, b: Column) -> Column:
    """The difference of two-digit groups over 90, one at most; 1/2 if one is missing."""
    return F.coalesce(F.least(F.abs(a.try_cast("int") - b.try_cast("int")) / 90.0, F.lit(1.0)), F.lit(0.5))


def effort(parts: DataFrame, weights: dict[str, float]) -> DataFrame:
    """parts with effort: the weighted mean of the parts that are known, within [0, 1]; null if none is."""
    total = sum((F.when(F.col(c).isNotNull(), w * F.col(c)).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    weight = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    return parts.withColumn("effort", F.when(weight > 0, F.least(F.greatest(total / weight, F.lit(0.0)), F.lit(1.0))))


def effort_band(score: Column, low: float = 0.3, high: float = 0.6) -> Column:
    return F.when(score <= low, "low").when(score <= high, "moderate").when(score.isNotNull(), "high")


def upskill_weeks(missing: Column, band: Column) -> tuple[Column, Column]:
    """Least and most weeks: five a missing skill, 40 % less and more; without one, by the band, as low where that is unknown."""
    low = F.when(missing > 0, F.greatest(F.lit(1), (5 * missing * 0.6).cast("int"))).when(band == "moderate", 12).when(band == "high", 36).otherwise(4)
    high = F.when(missing > 0, F.greatest(F.lit(4), (5 * missing * 1.4).cast("int"))).when(band == "moderate", 36).when(band == "high", 72).otherwise(12)
    return low, high


def rrf(lists: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, id, score, sources, rank) of (query_id, list, id, rank): sums of 1 / (k + rank); ties by id."""
    by = lists.groupBy("query_id", "id").agg(F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias("score"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("sources"))
    by = by.withColumn("score", F.round("score", 9))
    return by.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))


def weighted_rrf(lists: DataFrame, weights: dict[str, float], k: int = 60) -> DataFrame:
    """(query_id, id, score) with a weight a list; the weights are not negative and sum to one."""
    if any(w < 0 for w in weights.values()) or abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights must form a simplex")
    w = F.create_map(*[x for name, value in weights.items() for x in (F.lit(name), F.lit(value))])
    return lists.filter(F.col("list").isin(*weights)).groupBy("query_id", "id").agg(F.sum(w[F.col("list")] / (k + F.col("rank"))).alias("score"))


def weighted_rrf_grid(lists: DataFrame, weights: DataFrame, k: int = 60) -> DataFrame:
    """(config, query_id, id, score) under every weighting at once. weights: (config, list, weight), a small grid."""
    return lists.join(F.broadcast(weights), "list").groupBy("config", "query_id", "id").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"))


def head_fusion(primary: DataFrame, secondary: DataFrame, head: int = 3, new: int = 1) -> DataFrame:
    """(query_id, id, rank): the head of the first ranking, up to `new` ids of the second that it lacks,
    the rest of the first, the rest of the second."""
    p = primary.select("query_id", "id", F.when(F.col("rank") <= head, 0).otherwise(2).alias("tier"), "rank")
    fresh = secondary.join(primary.filter(F.col("rank") <= head).select("query_id", "id"), ["query_id", "id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("rank", "id")
    n = fresh.join(primary.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("n", F.row_number().over(w))
    q = n.select("query_id", "id", F.when(F.col("n") <= new, 1).otherwise(3).alias("tier"), "rank")
    return p.unionByName(q).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("tier", "rank", "id"))).select("query_id", "id", "rank")


def priority_combine(lists: DataFrame) -> DataFrame:
    """The rows of each query's best list by priority (query_id, priority, id, rank)."""
    return lists.withColumn("best", F.min("priority").over(Window.partitionBy("query_id"))).filter("priority = best").drop("best")


def pair_features(role_skills: DataFrame, least: int = 1) -> DataFrame:
    """(src, dst, cn, jaccard, aa, ra, pa, idf_overlap) of roles that share `least` skills or more.

    role_skills: (role, skill, degree, idf). Roles meet on skills; pairs without a common one have no row."""
    size = role_skills.groupBy("role").agg(F.count("*").alias("n"), F.sum("idf").alias("all"))
    x = role_skills.select(F.col("role").alias("src"), "skill", "degree", "idf")
    y = role_skills.select(F.col("role").alias("dst"), "skill")
    aa = F.when(F.col("degree") > 1, 1 / F.log(F.col("degree").cast("double"))).otherwise(0.0)
    by = x.join(y, "skill").filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("cn"), F.sum(aa).alias("aa"), F.sum(1 / F.col("degree")).alias("ra"), F.sum("idf").alias("shared"))
    a, z = size.select(F.col("role").alias("src"), F.col("n").alias("ns")), size.select(F.col("role").alias("dst"), F.col("n").alias("nt"), "all")
    j = by.filter(F.col("cn") >= least).join(a, "src").join(z, "dst")
    return j.select("src", "dst", "cn", (F.col("cn") / (F.col("ns") + F.col("nt") - F.col("cn"))).alias("jaccard"), "aa", "ra", (F.col("ns") * F.col("nt")).alias("pa"), F.when(F.col("all") > 0, F.col("shared") / F.col("all")).alias("idf_overlap"))


def tfidf(titles: DataFrame, terms: int = 8000) -> DataFrame:
    """(id, term, weight): words and pairs of words, sub-linear counts, smoothed idf, unit length."""
    words = F.filter(F.split(F.lower("title"), r"[^a-z0-9]+"), lambda x: x != "")
    both = titles.select("id", words.alias("w")).select("id", F.concat("w", F.transform(F.slice("w", 2, F.size("w")), lambda x, i: F.concat(F.get("w", i), F.lit(" "), x))).alias("t"))
    tf = both.select("id", F.explode("t").alias("term")).groupBy("id", "term").agg((1 + F.log(F.count("*").cast("double"))).alias("tf"))
    n = titles.agg(F.count("*").alias("titles"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("mass")).orderBy(F.desc("mass"), "term").limit(terms)
    x = tf.join(df, "term").crossJoin(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((1.0 + F.col("titles")) / (1 + F.col("df"))) + 1))
    return x.withColumn("weight", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))).select("id", "term", "weight")


def title_cosines(weights: DataFrame) -> DataFrame:
    """(src, dst, title_cosine) of titles with a term in common, from unit-length (id, term, weight)."""
    z = weights.select(F.col("id").alias("dst"), "term", F.col("weight").alias("z"))
    return weights.join(z, "term").filter("id <> dst").groupBy(F.col("id").alias("src"), "dst").agg(F.sum(F.col("weight") * F.col("z")).alias("title_cosine"))


def meta_paths(pairs: DataFrame) -> DataFrame:
    """(src, dst, meta): log2 of one more than the roles that both are linked with. pairs: (src, dst), both ways."""
    j = pairs.select("src", F.col("dst").alias("mid")).join(pairs.select(F.col("src").alias("dst"), F.col("dst").alias("mid")), "mid").filter("src <> dst")
    return j.groupBy("src", "dst").agg(F.log2(1.0 + F.count("*")).alias("meta"))
