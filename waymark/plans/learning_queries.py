"""Registered queries of streams, sinks and learnt models, with SQL where there is some."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import calibration as cal
from ..operators import lambda_rank as lr
from ..operators import models
from ..operators import ranker as rk
from ..operators import stores as st
from ..operators import trajectories as t
from ..sources import bridge as b
from ..sources.shared import cache_by_folder, new_folder, staged, stored
from ..streaming.incremental import run_available
from .graph_queries import _FULL, _TRANS, full_edges, idf_table, nodes, skills, transition_edges
from .model_queries import _NEAR, _NEAR_10, _VEC, _WALK, brand_neighbours, brand_vectors, held_out, role_vectors, smooth_predictions
from .scoring_queries import full_pair_features, missing_edge_candidates, requirements
from .trajectory_queries import CHAIN, _DATED, dated_rows, kept, train_counts, train_pairs


def incremental_transitions(s, d):
    """Transitions of a stream of three batches. Events whose id 11 divides leave gaps; at the end of a batch, positions of even events get a
    second label in the next one; a last row closes each person."""
    source, most = new_folder(s, "steps"), 40
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = b.table(s, d, "events").select(F.col("user_id").alias("person"), F.row_number().over(w).cast("long").alias("ord"), F.col("event_type").alias("label"), "event_id")
    plain = e.filter("event_id % 11 <> 0").withColumn("part", F.least(F.floor((F.col("ord") - 1) / most), F.lit(2)))
    late = plain.filter((F.col("ord") % most == 0) & (F.col("event_id") % 2 == 0) & (F.col("part") < 2)).withColumn("label", F.lit("other")).withColumn("part", F.col("part") + 1)
    end = plain.groupBy("person").agg((F.max("ord") + 1).alias("ord")).select("person", "ord", F.lit(None).cast("string").alias("label"), F.lit(2).alias("part"))
    every = plain.drop("event_id").unionByName(late.drop("event_id")).unionByName(end)
    files = int(s.conf.get("spark.sql.shuffle.partitions"))
    # numbered and joined once, not for each of the batches
    every = stored(every, "batches")
    for part in range(3):
        every.filter(F.col("part") == part).select("person", "ord", "label").repartition(files, "person").write.mode("append").parquet(source)
    pairs = run_available(s, source, "person long, ord long, label string", new_folder(s, "pairs"), new_folder(s, "state"), files)
    return pairs.groupBy("src", "dst").count()


def _graph_nodes(s, d):
    return nodes(s, d).unionByName(skills(s, d), allowMissingColumns=True).unionByName(b.groups(s, d), allowMissingColumns=True)


@cache_by_folder
def _stored_graph(s, d):
    folder = new_folder(s, "graph")
    st.sink_graph(_graph_nodes(s, d), full_edges(s, d), folder)
    return folder


def sink_graph(s, d):
    """Nodes by type and edges by relation, as they lie in the store, with their distinct keys."""
    folder = _stored_graph(s, d)
    n = s.read.parquet(f"{folder}/nodes").groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n"), F.countDistinct("entity_key").alias("keys"))
    return n.unionByName(s.read.parquet(f"{folder}/edges").groupBy(F.col("relation").alias("name")).agg(F.count("*").alias("n"), F.countDistinct("edge_key").alias("keys")))


def load_graph(s, d):
    """The stored edges as a graph again."""
    _, e = st.load_graph(s, _stored_graph(s, d))
    return e.select("src", "dst", "relation", "source", "requirement_level", F.round("importance", 6).alias("importance"), "count")


def store_validation(s, d):
    n, e = st.load_graph(s, _stored_graph(s, d))
    want = _graph_nodes(s, d).agg(F.lit("nodes").alias("kind"), F.count("*").alias("n")).unionByName(full_edges(s, d).agg(F.lit("edges").alias("kind"), F.count("*").alias("n")))
    return st.validate_graph(n, e, want)


def sink_vectors(s, d):
    """Points as they lie in the store."""
    folder = new_folder(s, "points")
    roles = nodes(s, d).select("id", "source", "title", "isco_group", "job_zone")
    st.sink_vectors(roles, role_vectors(s, d), folder)
    return s.read.parquet(folder).select("point_id", "dim", "payload")


def sink_reports(s, d):
    """How many rows each of a training split's three artefacts has, and one figure of each, read back."""
    folder = new_folder(s, "reports")
    clean = kept(s, d).filter("split = 'train'")
    st.sink_reports(clean, train_counts(s, d).select("src", "dst", "count"), clean.agg(F.count("*").alias("positions"), F.countDistinct("person").alias("people")), folder)
    a = s.read.parquet(f"{folder}/clean").agg(F.lit("clean").alias("artefact"), F.count("*").alias("rows"), F.countDistinct("person").alias("figure"))
    z = s.read.schema("src string, dst string, count long").option("header", True).csv(f"{folder}/counts").agg(F.lit("counts").alias("artefact"), F.count("*").alias("rows"), F.sum("count").alias("figure"))
    r = s.read.schema("positions long, people long").json(f"{folder}/report").agg(F.lit("report").alias("artefact"), F.count("*").alias("rows"), F.sum("positions").alias("figure"))
    return a.unionByName(z).unionByName(r)


def verify_manifest(s, d):
    """Files of each brand under several names, against a JSON manifest in which brands that end in 3 have another digest, those in 4
    another size, those in 5 are not listed, and which lists one file that isn't there. The digest is of the brand's part keys."""
    folder, notes = new_folder(s, "files"), new_folder(s, "manifest")
    keys = F.array_join(F.array_sort(F.collect_list(F.col("p_partkey"))), ",")
    text = b.table(s, d, "part").groupBy("p_brand").agg(keys.alias("value"))
    line = F.concat("value", F.lit("\n"))
    text.repartition("p_brand").write.partitionBy("p_brand").text(folder)
    # the names of Spark's files are its own: those of the listing, by brand
    files = st.listing(s, folder).withColumn("p_brand", F.regexp_extract(F.url_decode("name"), "p_brand=([^/]+)/", 1))
    want = files.join(text, "p_brand").select("name", "p_brand", F.length(line).cast("long").alias("bytes"), F.sha2(line.cast("binary"), 256).alias("sha256"))
    want = want.filter(~F.col("p_brand").endswith("5")).withColumn("bytes", F.when(F.col("p_brand").endswith("4"), F.col("bytes") + 1).otherwise(F.col("bytes"))).withColumn("sha256", F.when(F.col("p_brand").endswith("3"), F.lit("0")).otherwise(F.upper("sha256")))
    lost = s.range(1).select(F.lit("lost.csv").alias("name"), F.lit(1).cast("long").alias("bytes"), F.lit("0").alias("sha256"))
    entry = F.struct("name", F.struct("bytes", "sha256").alias("x"))
    want.select("name", "bytes", "sha256").unionByName(lost).agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(entry)).alias("files"))).alias("value")).write.text(notes)
    return st.verify_manifest(s, folder, st.read_manifest(s, notes)).groupBy("status").agg(F.count("*").alias("files"))


def scan_crosswalk(s, d):
    """A crosswalk written with other headers than its reader knows, read back."""
    folder = new_folder(s, "crosswalk")
    r = b.roles_b(s, d).select(F.concat(F.substring("id", 3, 20), F.lit(".00 ")).alias("Some-SOC 2019 Code"), F.when(F.col("job_zone") != 2, F.col("isco_group")).alias("Code of ISCO-08"), F.col("title").alias("Title"))
    r.write.option("header", True).csv(folder)
    return st.crosswalk(s.read.option("header", True).csv(folder))


def scan_occupation_tables(s, d):
    """Roles of the second source written as tab-separated text, as exports of spreadsheets are, and read back with a schema."""
    folder = new_folder(s, "tables")
    b.roles_b(s, d).write.option("header", True).option("sep", "\t").csv(folder)
    schema = "id string, type string, source string, title string, isco_group string, job_zone int, typical_education_level string"
    return s.read.schema(schema).option("header", True).option("sep", "\t").csv(folder)


def scan_taxonomy_csv(s, d):
    """Roles written as quoted CSV and read back with a schema."""
    folder = new_folder(s, "csv")
    roles = b.roles_a(s, d).withColumn("title", F.concat("title", F.lit(', "the"\nsecond line')))
    roles.write.option("header", True).option("escape", '"').csv(folder)
    return s.read.schema("id string, type string, source string, title string, isco_group string, esco_code string").csv(folder, header=True, multiLine=True, escape='"')


def scan_trajectory_splits(s, d):
    """One table a split, found by name among others, with a column that isn't needed."""
    folder = new_folder(s, "splits")
    names = {"train": "steps_train", "validation": "steps_validation", "test": "steps_test"}
    for split, name in names.items():
        b.career_steps(s, d).filter(F.col("split") == split).select("ord", "person", F.lit("x").alias("note"), "label").write.option("header", True).csv(f"{folder}/{name}")
    files = s.createDataFrame([(f"{folder}/{name}",) for name in (*names.values(), "readme")], "path string")
    rows = st.split_files(s, files, "ord long, person long, note string, label string", ("person", "ord", "label"))
    return rows.groupBy("split").agg(F.count("*").alias("rows"), F.countDistinct("person").alias("people"), F.sum("ord").alias("ords"))


def scan_dated_steps(s, d):
    folder = new_folder(s, "dated")
    b.dated_steps(s, d).write.parquet(folder)
    return s.read.parquet(folder).select("resume_id", "matched_code", "start_date")


@staged
def lp_training_set(s, d):
    near = brand_neighbours(s, d, 10).select(F.concat(F.lit("a:"), "id").alias("src"), F.concat(F.lit("a:"), "nbr").alias("dst"), "similarity")
    return models.training_set(transition_edges(s, d).select("src", "dst"), missing_edge_candidates(s, d), near, 5)


LP_FEATURES = ["cn", "jaccard", "aa", "ra", "pa", "cosine", "group_distance", "idf_overlap", "evidence", "title_cosine", "meta"]


def lp_train_score(s, d):
    """The ten best missing edges of each role by trees on all eleven pair features."""
    rows = missing_edge_candidates(s, d).unionByName(transition_edges(s, d).select("src", "dst")).join(full_pair_features(s, d), ["src", "dst"], "left").na.fill(0)
    learn = lp_training_set(s, d).join(rows, ["src", "dst"])
    if learn.isEmpty():  # no observed edge, nothing to learn from
        return s.createDataFrame([], "src string, dst string, score double, rank int")
    model = models.fit(learn, LP_FEATURES)
    return models.predict(model, rows.join(missing_edge_candidates(s, d), ["src", "dst"], "left_semi"), 10, LP_FEATURES)


def dated_counts(s, d):
    """(src, dst, count): transitions of the dated histories of training people, by brand."""
    pairs = t.dated_pairs(dated_rows(s, d)).filter("reason = 'valid' and person % 10 <= 7")
    return pairs.groupBy(F.substring("src", 3, 100).alias("src"), F.substring("dst", 3, 100).alias("dst")).agg(F.count("*").alias("count"))


def _ranker_rows(s, d, counts):
    vec, ids = brand_vectors(s, d), b.roles_a(s, d).select(F.col("title").alias("id"), F.substring("isco_group", 1, 2).alias("g"))
    own = b.requires(s, d).filter("source = 'esco'").join(idf_table(s, d), "dst", "left").select(F.substring("src", 3, 100).alias("role"), F.col("dst").alias("skill"), F.coalesce("idf", F.lit(1.0)).alias("idf"))
    return rk.rows(counts, brand_neighbours(s, d, 10), vec, ids, own, dated_counts(s, d), 40)


@staged
def ranker_rows(s, d):
    """Candidates of every source from seven channels, with 33 features and graded validation labels. The other dataset is
    that of dated histories, of people of the training split alone."""
    return rk.graded(_ranker_rows(s, d, train_counts(s, d, 5)), held_out(s, d, "validation"))


def ranker_features(s, d):
    r = ranker_rows(s, d)
    return r.select("src", "dst", *[F.round(c, 5).alias(c) for c in rk.FEATURES], "grade")


def ranker_recall(s, d):
    return rk.recall(ranker_rows(s, d), held_out(s, d, "validation"))


FOLDS = 2


@staged
def out_of_fold_rows(s, d):
    """Rows to learn from: for each fold of training people, candidates and features by the other folds' transitions, graded
    by its own; a list is a source in a fold."""
    out, pairs = None, train_pairs(s, d).withColumn("fold", t.stable_fold(F.col("person"), FOLDS))
    for k in range(FOLDS):
        counts = t.transition_counts(pairs.filter(F.col("fold") != k).drop("fold")).filter("count >= 3")
        labels = pairs.filter(F.col("fold") == k).groupBy("src", "dst").agg(F.count("*").alias("count"))
        rows = rk.graded(_ranker_rows(s, d, counts), labels).withColumn("src", F.concat_ws("@", "src", F.lit(k)))
        out = rows if out is None else out.unionByName(rows)
    return out


@staged
def ranker_scores(s, d):
    """Rankings of all candidates under every configuration of the ranker."""
    return lr.scored_grid(lr.packed(out_of_fold_rows(s, d), rk.FEATURES), lr.packed(ranker_rows(s, d), rk.FEATURES))


def chosen_ranking(s, d):
    """The ranking of the configuration with the best validation metrics."""
    scores = ranker_scores(s, d)
    return scores.join(F.broadcast(lr.best(lr.metrics_by(scores, held_out(s, d, "validation"), ["config"]), ["config"])), "config")


def _baseline(s, d):
    return smooth_predictions(s, d).select("src", "dst", "rank")


@staged
def fused_rankings(s, d):
    """Smoothed transitions with the ranker's fused in: every head and number of slots, and whether validation chose it."""
    grid = lr.fusion_grid(_baseline(s, d), chosen_ranking(s, d).select("src", "dst", "rank"))
    pick = lr.best(lr.metrics_by(grid, held_out(s, d, "validation"), ["head", "slots"]), ["head", "slots"])
    return grid.join(F.broadcast(pick), ["head", "slots"])


def ranker_train(s, d):
    """The fused ranking that validation chose, with the ranker's own score and rank and the configurations chosen."""
    own = chosen_ranking(s, d).select("src", "dst", "config", "score", F.col("rank").alias("own_rank"))
    return fused_rankings(s, d).join(own, ["src", "dst"], "left").select("src", "dst", "rank", "own_rank", "score", "config", "head", "slots")


def ranker_gate(s, d):
    """Whether the fused ranking may take the baseline's place, judged on validation and test people."""
    out = None
    for split in ("validation", "test"):
        stages = _baseline(s, d).withColumn("stage", F.lit("before")).unionByName(fused_rankings(s, d).select("src", "dst", "rank", F.lit("after").alias("stage")))
        m = lr.metrics_by(stages, held_out(s, d, split), ["stage"]).withColumn("split", F.lit(split))
        out = m if out is None else out.unionByName(m)
    return lr.gate(out)


@staged
def observed_steps(s, d):
    """(split, event, known, src, dst): observed steps of training and validation people with the roles before them as one sorted text, which says what
    a person owns."""
    role = lambda c: F.concat(F.lit("a:"), c)
    one = lambda split: t.prefixes(kept(s, d).filter(F.col("split") == split)).withColumn("split", F.lit(split))
    p = one("train").unionByName(one("validation"))
    known = F.array_join(F.array_sort(F.array_distinct(F.transform("history", role))), "|")
    return p.select("split", F.concat_ws("|", "person", "ord").alias("event"), known.alias("known"), role(F.element_at("history", -1)).alias("src"), role(F.col("target")).alias("dst"))


@staged
def role_lists(s, d):
    """(role, isco_group, grp, skills): roles of the first source with their skills and these' idf."""
    need = requirements(s, d).filter("role like 'a:%'").join(idf_table(s, d).select(F.col("dst").alias("skill"), F.round("idf", 9).alias("idf")), "skill", "left").select("role", F.struct("skill", F.coalesce("idf", F.lit(1.0)).alias("idf")).alias("x"))
    by = need.groupBy("role").agg(F.sort_array(F.collect_set("x")).alias("skills"))
    roles = b.roles_a(s, d).select(F.col("id").alias("role"), "isco_group", F.substring("isco_group", 1, 2).alias("grp")).join(by, "role", "left")
    return roles.withColumn("skills", F.coalesce("skills", F.array().cast(by.schema["skills"].dataType)))


def _known_parts(s, d, asked):
    """(known, src, role) with the parts of effort; who had the roles of `known` owns what they need. Each triple once."""
    roles, each = role_lists(s, d), asked.select("known", "src", "role").distinct()
    of = each.select("known").distinct().select(F.col("known").alias("event"), F.explode(F.split("known", r"\|")).alias("role"))
    owned = of.join(roles.select("role", "skills"), "role").select("event", F.explode("skills").alias("x")).groupBy("event").agg(F.collect_set("x").alias("skills"))
    support = transition_edges(s, d).select("src", F.col("dst").alias("role"), F.least(F.lit(1.0), F.col("probability") * F.log2(1.0 + F.col("count"))).alias("support"))
    return cal.step_features(each.withColumnRenamed("known", "event"), owned, roles.select("role", F.col("isco_group").alias("grp"), "skills"), support).withColumnRenamed("event", "known")


@staged
def drawn_alternatives(s, d):
    """(known, src, dst, role, weight, n): the alternatives drawn for every training step; those of steps that know the same and lead
    from and to the same roles are summed up where they are drawn."""
    steps = observed_steps(s, d).filter("split = 'train'")
    popular = steps.select(F.col("dst").alias("role")).distinct().withColumn("popular", F.lit(True))
    drawn = cal.sample_alternatives(steps, role_lists(s, d).join(popular, "role", "left"), by=("known", "src", "dst"))
    return drawn.groupBy("known", "src", "dst", "role").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))


@staged
def calibration_parts(s, d):
    """Parts of effort of all that training and validation steps and their alternatives lead to."""
    steps = observed_steps(s, d).select("known", "src", F.col("dst").alias("role"))
    return _known_parts(s, d, steps.unionByName(drawn_alternatives(s, d).select("known", "src", "role")))


@staged
def calibration_pairs(s, d):
    """Differences of every training step and its sampled alternatives, equal ones summed up."""
    parts, drawn = calibration_parts(s, d), drawn_alternatives(s, d)
    event = F.concat_ws(">", "known", "src", "dst").alias("event")
    ends = drawn.select("known", "src", "dst").distinct()
    observed = ends.withColumn("role", F.col("dst")).join(parts, ["known", "src", "role"]).select(event, *cal.PARTS)
    return cal.differences(observed, drawn.join(parts, ["known", "src", "role"]).select(event, *cal.PARTS, "weight", "n"))


def effort_calibration(s, d):
    """Weights of the four parts of effort under which observed training steps are cheaper than the alternatives drawn for each,
    and limits of the bands from observed validation steps. Every training step takes part."""
    steps = observed_steps(s, d).filter("split = 'validation'").select("known", "src", F.col("dst").alias("role"))
    return cal.calibration(s, calibration_pairs(s, d), steps.join(calibration_parts(s, d), ["known", "src", "role"]))


QUERIES = {f.__name__: f for f in (
    incremental_transitions, sink_graph, load_graph, store_validation, sink_vectors, sink_reports, verify_manifest, scan_crosswalk, scan_occupation_tables, scan_taxonomy_csv, scan_trajectory_splits,
    scan_dated_steps, lp_training_set, lp_train_score, ranker_features, ranker_recall, ranker_train, ranker_gate, effort_calibration,
)}

_ORDER = "order by round({}, 9) desc, dst"
_RANKER = f"""{CHAIN}, {_VEC}, {b.SQL_REQUIRES}, {_NEAR}, {_NEAR_10}, idf as (select dst, ln((select count(*) from (select id from roles_a union all select id from roles_b)) / count(*)) as idf from requires group by dst), {_WALK}
, dated_c as (select substr(src, 3) as src, substr(dst, 3) as dst, count(*) as count from ({_DATED} select * from pairs) where reason = 'valid' and person % 10 <= 7 group by all), held_v as (select src, dst, count(*) as count from classified where reason = 'valid' and split = 'validation' group by src, dst
), ids as (select title as id, cast(substr(isco_group, 1, 2) as int) as g from roles_a
), kn as (select *, exp((similarity - max(similarity) over (partition by id)) / 0.05) as e from nearest10 where nbr in (select src from c5)), ku as (select *, e / sum(e) over (partition by id) as u from kn
), sem as (select id as src, dst, sum(u * probability) as sp, max(similarity) as ss, count(*) as sn from ku join c5 on nbr = c5.src where dst <> id group by id, dst
), wk as (select src, dst, coalesce(a.p, 0) as p2, coalesce(z.p, 0) as p3 from w2 a full join w3 z using (src, dst)
), own as (select substr(src, 3) as role, dst as skill, coalesce(idf, 1) as idf from requires left join idf using (dst) where source = 'esco'
), shd as (select a.role as src, z.role as dst, count(*) as bo, sum(a.idf) as si from own a join own z using (skill) where a.role <> z.role group by all), sz as (select role, count(*) as n, sum(idf) as al from own group by role
), pop as (select dst, sum(count) as dc from c5 group by dst), ax as (select src, dst, count as ac, count / sum(count) over (partition by src) as ap from dated_c
), ch as (
  select src, dst, 'direct' as c from (select *, row_number() over (partition by src {_ORDER.format('probability')}) as r from c5) where r <= 40
  union all select src, dst, 'semantic' from (select *, row_number() over (partition by src {_ORDER.format('sp')}) as r from sem) where r <= 40
  union all select src, dst, 'walk' from (select *, row_number() over (partition by src {_ORDER.format('p2 + 0.25 * p3')}) as r from wk) where r <= 40
  union all select id, nbr, 'embedding' from nearest10
  union all select src, dst, 'skill' from (select *, row_number() over (partition by src {_ORDER.format('si')}) as r from shd) where r <= 40
  union all select id, dst, 'popular' from ids, (select dst from pop order by dc desc, dst limit 40)
  union all select src, dst, 'aux' from (select *, row_number() over (partition by src {_ORDER.format('ap')}) as r from ax) where r <= 40
), ca as (select src, dst, {', '.join(f"max((c = '{x}')::int) as in_{x}" for x in rk.CHANNELS)} from ch where src <> dst group by src, dst
), fs as (
  select ca.*, coalesce(c5.count, 0) as n, coalesce(c5.probability, 0) as pr, coalesce(st.tot, 0) as tot, coalesce(sp, 0) as sp, coalesce(ss, 0) as ss, coalesce(sn, 0) as sn, coalesce(p2, 0) as p2, coalesce(p3, 0) as p3, coalesce(sims.similarity, 0) as co,
    ca.src not in (select substr(id, 3) from unit) or ca.dst not in (select substr(id, 3) from unit) as vm, x.g as gx, y.g as gy, coalesce(bo, 0) as bo, coalesce(si, 0) as si, coalesce(sx.n, 0) as nx, coalesce(sy.n, 0) as ny, coalesce(sy.al, 0) as ay,
    coalesce(dc, 0) as dc, coalesce(ac, 0) as ac, coalesce(ap, 0) as ap, coalesce(hv.count, 0) as hv
  from ca left join c5 on c5.src = ca.src and c5.dst = ca.dst left join (select src, max(source_total) as tot from c5 group by src) st on st.src = ca.src left join sem on sem.src = ca.src and sem.dst = ca.dst left join wk on wk.src = ca.src and wk.dst = ca.dst
    left join sims on sims.id = 'a:' || ca.src and sims.nbr = 'a:' || ca.dst left join ids x on x.id = ca.src left join ids y on y.id = ca.dst left join shd on shd.src = ca.src and shd.dst = ca.dst left join sz sx on sx.role = ca.src left join sz sy on sy.role = ca.dst
    left join pop on pop.dst = ca.dst left join ax on ax.src = ca.src and ax.dst = ca.dst left join held_v hv on hv.src = ca.src and hv.dst = ca.dst
)"""
ORACLE_SQL = {
    "ranker_features": f"""{_RANKER} select src, dst, cast(columns(* exclude (src, dst, grade)) as double), grade from (select src, dst, round(pr, 5) as probability, n as count, round(ln(1 + n), 5) as log_count, round(ln(1 + tot), 5) as log_total, round(case when tot > 0 then n / (tot + 5) else 0 end, 5) as shrunk, (n >= 2)::int as count_2, (n >= 3)::int as count_3, (n >= 5)::int as count_5,
      round(sp, 5) as semantic_p, round(ss, 5) as semantic_similarity, sn as semantic_support, round(p2, 5) as walk_2, round(p3, 5) as walk_3, round(co, 5) as cosine, vm::int as vector_missing, coalesce((gx = gy)::int, 0) as same_group, round(coalesce(least(abs(gx - gy) / 90, 1), 0.5), 5) as group_distance,
      round(case when nx + ny - bo > 0 then bo / (nx + ny - bo) else 0 end, 5) as skill_jaccard, round(case when ay > 0 then si / ay else 0 end, 5) as idf_coverage, round(case when ny > 0 then (ny - bo) / ny else 0 end, 5) as skill_gap, coalesce(round(dc / (select sum(count) from c5), 5), 0) as popularity, round(ln(1 + dc), 5) as log_popularity,
      {', '.join(f'in_{x}' for x in rk.CHANNELS)}, round(ap, 5) as aux_p, ac as aux_count, round(ln(1 + ac), 5) as aux_log_count, (ac > 0)::int as aux_seen, case when hv >= 4 then 3 when hv >= 2 then 2 when hv >= 1 then 1 else 0 end as grade from fs)""",
    "ranker_recall": f"""{_RANKER} select count(distinct src) as queries, count(*) as rows, count(*) filter (hv > 0) as positive_rows, (select coalesce(sum(count), 0) from held_v where src in (select src from fs))::bigint as truth, coalesce(sum(hv), 0)::bigint as recalled from fs""",
    "incremental_transitions": """with e as (select user_id as person, row_number() over (partition by user_id order by ts, event_id) as ord, event_type as label, event_id from events
      ), k as (select person, ord, label, ord % 40 = 0 and event_id % 2 = 0 and ord <= 80 as doubled from e where event_id % 11 <> 0
      ), p as (select ord, label as src, lead(label) over w as dst, lead(ord) over w as nxt from k where not doubled or label = 'other' window w as (partition by person order by ord))
      select src, dst, count(*) as count from p where nxt = ord + 1 and src <> dst group by all""",
    "lp_training_set": f"""{CHAIN}, {_VEC}, {_NEAR_10}, {_TRANS}, q as (select src, 5 * count(*) as n from trans group by src
      ), h0 as (select 'a:' || id as src, 'a:' || nbr as dst, similarity from nearest10), hd as (select src, dst from (select h.src, h.dst, q.n, row_number() over (partition by h.src order by similarity desc, h.dst) as r from h0 h join q using (src) where (h.src, h.dst) not in (select (src, dst) from trans)) where r <= n // 2
      ), fr as (select src, dst from (select a.id as src, z.id as dst, q.n, row_number() over (partition by a.id order by md5(a.id || '|' || z.id), z.id) as r from roles_a a join roles_a z on a.id <> z.id join q on q.src = a.id where (a.id, z.id) not in (select (src, dst) from trans) and (a.id, z.id) not in (select (src, dst) from hd)) where r <= n - n // 2)
      select src, dst, 1.0::double as label from trans union all select src, dst, 0 from hd union all select src, dst, 0 from fr""",
    "sink_graph": f"{_FULL} select type as name, count(*) as n, count(*) as keys from (select type from nodes union all select type from skills union all select type from groups_) group by type union all select relation, count(*), count(distinct src || '>' || dst || '>' || source) from fe group by relation",
    "load_graph": f"{_FULL} select src, dst, relation, source, requirement_level, round(importance, 6) as importance, count from fe",
    "store_validation": f"""{_FULL} select 'count' as "check", 'nodes' as name, (select count(*) from nodes) + (select count(*) from skills) + (select count(*) from groups_) as n, true as ok union all select 'count', 'edges', count(*), true from fe
      union all select 'relation', relation, count(*), true from fe group by relation union all select * from (select 'requirements', src, count(*), true from fe where relation = 'REQUIRES' group by src order by src limit 1)
      union all select * from (select 'transition', src || ' > ' || dst, count, true from trans order by count desc, src, dst limit 5)""",
    "sink_vectors": f"""with {_VEC}, r as (select id, source, title, isco_group, null::int as job_zone from roles_a union all select id, source, title, isco_group, job_zone from roles_b), h as (select *, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('role::' || id)) as h from r where id in (select id from unit))
      select substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', cast('0x' || substr(h, 17, 1) as int) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as point_id, 64 as dim,
        chr(123) || '"role_id":"' || id || '","source":"' || source || '","title":"' || title || '","isco_group":"' || isco_group || '"' || case when job_zone is not null then ',"job_zone":' || job_zone else '' end || chr(125) as payload from h""",
    "sink_reports": f"{CHAIN} select 'clean' as artefact, count(*) as rows, count(distinct person) as figure from kept where split = 'train' union all select 'counts', count(*), sum(count)::bigint from counts union all select 'report', 1, count(*) from kept where split = 'train'",
    "verify_manifest": """with f as (select distinct p_brand as n from part) select case when n like '%3' then 'wrong digest' when n like '%4' then 'wrong size' when n like '%5' then 'unlisted' else 'ok' end as status, count(*) as files from f group by 1 union all select 'missing', 1""",
    "scan_crosswalk": "select s_suppkey || '.00' as soc, cast(10 + s_nationkey as varchar) as isco, cast(s_suppkey as varchar) as short from supplier where 1 + s_suppkey % 5 <> 2",
    "scan_occupation_tables": f"with {b.SQL_ROLES_B} select * from roles_b",
    "scan_taxonomy_csv": f"with {b.SQL_ROLES_A} select id, type, source, title || ', \"the\"' || chr(10) || 'second line' as title, isco_group, esco_code from roles_a",
    "scan_trajectory_splits": f"with {b.SQL_STEPS} select split, count(*) as rows, count(distinct person) as people, sum(ord)::bigint as ords from steps group by split",
    "scan_dated_steps": f"with {b.SQL_DATED} select resume_id, matched_code, start_date from dated",
}
