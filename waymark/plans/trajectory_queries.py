"""Registered queries over histories, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import trajectories as t
from ..sources import bridge as b
from ..sources.shared import staged

WITH = f"with {b.SQL_STEPS}"
SQL_POSITIONS = """positions as (
  select person, ord, split, min(label) as label, count(label) as n_rows, count(distinct label) as n_labels from steps group by person, ord, split
), kept as (select * from positions where n_labels = 1
), paired as (
  select person, split, ord, label as src, lead(label) over w as dst, lead(ord) over w as next_ord from kept window w as (partition by person order by ord)
), classified as (
  select person, split, ord, src, dst, case when next_ord <> ord + 1 then 'gap' when src = dst then 'self' else 'valid' end as reason from paired where next_ord is not null
), train_pairs as (select person, src, dst from classified where reason = 'valid' and split = 'train'
), counted as (select src, dst, count(*) as count from train_pairs group by src, dst
), totals as (select *, cast(sum(count) over (partition by src) as bigint) as source_total from counted
), counts as (select *, count / source_total as probability from totals)"""
CHAIN = f"{WITH}, {SQL_POSITIONS}"


@staged
def train_pairs(s: SparkSession, d: str) -> DataFrame:
    return t.transitions(b.career_steps(s, d).filter("split = 'train'"))


@staged
def _counts(s: SparkSession, d: str) -> DataFrame:
    return t.transition_counts(train_pairs(s, d))


def train_counts(s: SparkSession, d: str, support: int = 1) -> DataFrame:
    return _counts(s, d).filter(F.col("count") >= support)


@staged
def kept(s: SparkSession, d: str) -> DataFrame:
    """(person, ord, split, label): positions with one label."""
    return t.kept_positions(b.career_steps(s, d), ("split",))


@staged
def all_prefixes(s: SparkSession, d: str) -> DataFrame:
    return t.prefixes(kept(s, d))


def dated_rows(s: SparkSession, d: str) -> DataFrame:
    return t.dated_rows(b.dated_steps(s, d), b.code_index(s, d))


def _p(c: str = "probability"):
    return F.round(c, 6).alias(c)


def collapse_positions(s, d):
    return t.collapse_positions(b.career_steps(s, d))


def consecutive_transitions(s, d):
    return t.classified_pairs(kept(s, d))


def transition_counts(s, d):
    return train_counts(s, d, 5).select("src", "dst", "count", "source_total", _p())


def top_destinations(s, d):
    w = Window.partitionBy("src").orderBy(F.desc("count"), "dst")
    return train_counts(s, d, 5).withColumn("rank", F.row_number().over(w)).filter("rank <= 12").select("src", "dst", "count", "source_total", _p(), "rank")


def trajectory_quality(s, d):
    """Orders before the second year are read as ill-formed and labels that end in 7 are in no index, on purpose."""
    steps = b.career_steps(s, d).withColumn("ord", F.when(F.col("ord") >= 4, F.col("ord")))
    return t.quality(steps, b.code_index(s, d).select(F.col("code").alias("label")))


def support_retention(s, d):
    return t.support_retention(train_counts(s, d)).withColumn("ratio", F.round("ratio", 6))


def _long(df: DataFrame) -> DataFrame:
    """Arrays as text, for comparison."""
    return df.withColumn("history", F.array_join("history", ">"))


def prefixes(s, d):
    return _long(all_prefixes(s, d))


def second_order_prefixes(s, d):
    return t.second_order(all_prefixes(s, d))


def pretrain_prefixes(s, d):
    candidates = train_counts(s, d, 5).select(F.col("dst").alias("label")).distinct()
    steps = kept(s, d).join(candidates, "label", "left_semi")
    return _long(t.prefixes(steps, gap_breaks=False))


def second_order_counts(s, d):
    got = t.second_order(t.prefixes(kept(s, d).filter("split = 'train'")))
    return got.groupBy("previous", "current", "dst").count().withColumn("context_total", F.sum("count").over(Window.partitionBy("previous", "current")))


def history_cap(s, d):
    return _long(t.history_cap(kept(s, d), 3))


def fold_counts(s, d):
    return t.fold_counts(train_pairs(s, d))


def transition_context(s, d):
    return t.transition_context(train_counts(s, d)).withColumn("popularity", F.round("popularity", 6))


def parse_quarter(s, d):
    rows = b.dated_steps(s, d)
    return rows.groupBy(t.parse_quarter(F.col("start_date")).alias("start"), t.parse_quarter(F.col("end_date")).alias("end")).count()


def dated_transitions(s, d):
    return t.dated_pairs(dated_rows(s, d)).groupBy("src", "dst", "reason").agg(F.count("*").alias("count"), F.count_if("overlap").alias("overlaps"))


def dated_quality(s, d):
    return t.dated_quality(b.dated_steps(s, d), b.code_index(s, d))


def overlap_flag(s, d):
    """Pairs of neighbours that are in order, and how many of them overlap."""
    return t.dated_pairs(dated_rows(s, d)).filter("reason <> 'ambiguous'").groupBy("person").agg(F.count_if("overlap").alias("overlaps"), F.count("*").alias("pairs"))


def tenure_gap_buckets(s, d):
    """Buckets of each row and of the gap to the row before it, with how often they occur."""
    w = Window.partitionBy("person").orderBy("order", "role", F.asc_nulls_last("start"), F.asc_nulls_last("end"), "university_level")
    rows = dated_rows(s, d).withColumn("before", F.lag("end").over(w))
    return rows.groupBy(t.tenure_bucket(F.col("start"), F.col("end")).alias("tenure"), t.gap_bucket(F.col("before"), F.col("start")).alias("gap"), t.education_bucket(F.col("university_level"), True).alias("education")).count()


def feature_prefixes(s, d):
    return t.feature_prefixes(dated_rows(s, d), 3, True).withColumn("history", F.array_join("history", ">"))


def feature_availability(s, d):
    f = t.feature_prefixes(dated_rows(s, d), 20, True)
    return f.agg(F.count("*").alias("prefixes"), F.count_if(F.col("tenure") == 0).alias("missing_tenure"), F.count_if(F.col("gap") == 0).alias("missing_gap"), F.count_if(F.col("education") != 0).alias("with_education"))


def person_runs(s, d):
    """Runs of one customer in the orders as they lie, as one file in order of date and key."""
    rows = b.table(s, d, "orders").select(F.year("o_orderdate").alias("file"), F.col("o_orderkey").alias("row_pos"), F.floor(F.col("o_custkey") / 100).alias("person"))
    return t.person_runs(rows)


def out_of_order_people(s, d):
    rows = b.table(s, d, "orders").select(F.col("o_custkey").alias("person"), (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).alias("ord"), F.col("o_orderkey").alias("row_pos"))
    return t.out_of_order(rows)


def split_disjointness(s, d):
    steps = b.career_steps(s, d)
    shared = t.split_overlap(steps)
    names = ["test", "train", "validation"]
    every = s.createDataFrame([(x, y) for i, x in enumerate(names) for y in names[i + 1 :]], "first string, second string")
    return every.join(shared, ["first", "second"], "left").select("first", "second", F.coalesce("people", F.lit(0).cast("long")).alias("people"))


def distinct_rows(s, d):
    rows = b.career_steps(s, d)
    return rows.agg(F.count("*").alias("rows")).crossJoin(rows.distinct().agg(F.count("*").alias("distinct_rows"))).withColumn("dropped", F.col("rows") - F.col("distinct_rows"))


def unmapped_labels(s, d):
    """Labels that the index (which lacks those that end in 7, on purpose) doesn't know."""
    return b.career_steps(s, d).join(b.code_index(s, d), F.col("label") == F.col("code"), "left_anti").groupBy("label").agg(F.count("*").alias("rows"))


def stable_fold(s, d):
    return b.table(s, d, "customer").groupBy(t.stable_fold(F.col("c_custkey"), 5).alias("fold")).agg(F.count("*").alias("people"))


QUERIES = {f.__name__: f for f in (
    collapse_positions, consecutive_transitions, transition_counts, top_destinations, trajectory_quality, support_retention, prefixes, second_order_prefixes, pretrain_prefixes,
    second_order_counts, history_cap, fold_counts, transition_context, parse_quarter, dated_transitions, dated_quality, overlap_flag, tenure_gap_buckets, feature_prefixes,
    feature_availability, person_runs, out_of_order_people, split_disjointness, distinct_rows, unmapped_labels, stable_fold,
)}

_PREFIX = """islands as (
  select person, ord, label, sum(brk) over (partition by person order by ord) as island
  from (select person, ord, label, case when lag(ord) over (partition by person order by ord) = ord - 1 then 0 else 1 end as brk from {src})
), squeezed as (
  select * from (select *, lag(label) over (partition by person, island order by ord) as before from islands) where before is null or before <> label
), prefixes as (
  select person, ord, list(label) over w as history, label as target from squeezed
  window w as (partition by person, island order by ord rows between unbounded preceding and 1 preceding)
)"""
_SECOND = "second as (select person, ord, history[-2] as previous, history[-1] as current, target as dst from prefixes where len(history) >= 2)"
_Q = "case when trim({c}) similar to 'Q[1-4]\\s+[0-9]{{4}}' then cast(right(trim({c}), 4) as int) * 4 + cast(substr(trim({c}), 2, 1) as int) - 1 end"
_DATED = f"""with {b.SQL_DATED}, stages as (
  select resume_id as person, trim(coalesce(matched_code, '')) as code, case when matched_code like 'Brand%' and matched_code not like '%7' then 'a:' || matched_code end as role, {_Q.format(c='start_date')} as s, {_Q.format(c='end_date')} as e,
    case university_level when 'Secondary school' then 'Secondary' when 'Diploma' then null else university_level end as level, start_date, end_date
  from (select distinct * from dated)
), staged as (
  select *, case when code = '' or lower(code) = 'unknown' then 'unknown' when role is null then 'unmapped' when e < s then 'range' when s is null and e is null then 'unordered' else 'accepted' end as reason from stages
), dated_rows as (select person, code, role, coalesce(s, e) as o, s, e, coalesce(level, 'None') as level, level is null as bad_level from staged where reason = 'accepted'
), near as (
  select person, role as src, o, e, lead(role) over w as dst, lead(o) over w as next_o, lead(s) over w as next_s from dated_rows
  window w as (partition by person order by o, e asc nulls last, code, role, s asc nulls first, level)
), pairs as (
  select person, src, dst, case when next_o = o then 'ambiguous' when src = dst then 'self' else 'valid' end as reason, next_o <> o and coalesce(next_s < e, false) as overlap from near where next_o is not null
)"""
_TEN = "case when {a} is null or {b} is null then 0 when {b} - {a} <= 0 then 1 when {b} - {a} <= 1 then 2 when {b} - {a} <= 3 then 3 when {b} - {a} <= 7 then 4 when {b} - {a} <= 15 then 5 when {b} - {a} <= 31 then 6 when {b} - {a} <= 63 then 7 else 8 end"
_GAP = "case when {a} is null or {b} is null then 0 when {b} < {a} then 1 when {b} = {a} then 2 when {b} - {a} <= 1 then 3 when {b} - {a} <= 3 then 4 when {b} - {a} <= 7 then 5 when {b} - {a} <= 15 then 6 else 7 end"
_EDU = "case {} when 'None' then 1 when 'Secondary' then 2 when 'Bachelor' then 3 when 'Master' then 4 when 'PhD' then 5 end"
#: The fold over a person's rows, row by row in a recursive query.
_FOLD = f"""{_DATED.replace('with ', 'with recursive ', 1)}, numbered as (
  select *, row_number() over (partition by person order by o, role, s asc nulls first, e asc nulls first, level) as i from dated_rows
), fold(person, i, kept) as (
  select person, i, [{{'o': o, 'role': role, 's': s, 'e': e, 'level': level}}] from numbered where i = 1
  union all
  select n.person, n.i, case when kept[-1].o = n.o or kept[-1].role = n.role then kept else list_append(kept, {{'o': n.o, 'role': n.role, 's': n.s, 'e': n.e, 'level': n.level}}) end from fold f join numbered n on n.person = f.person and n.i = f.i + 1
), done as (select person, arg_max(kept, i) as kept from fold group by person
), fp as (
  select person, n, [x.role for x in kept[greatest(1, n - 2):n]] as history, kept[n + 1].role as target, {_TEN.format(a='kept[n].s', b='kept[n].e')} as tenure,
    case when n > 1 then {_GAP.format(a='kept[n - 1].e', b='kept[n].s')} else 0 end as gap, {_EDU.format('kept[n].level')} as education
  from (select person, kept, unnest(range(1, len(kept))) as n from done)
)"""

ORACLE_SQL = {
    "collapse_positions": f"{WITH} select person, ord, min(label) as label, count(label) as n_rows, count(distinct label) as n_labels from steps group by person, ord",
    "consecutive_transitions": f"{CHAIN} select person, ord, src, dst, reason from classified",
    "transition_counts": f"{CHAIN} select src, dst, count, source_total, round(probability, 6) as probability from counts where count >= 5",
    "top_destinations": f"""{CHAIN} select src, dst, count, source_total, round(probability, 6) as probability, rank from (
      select *, row_number() over (partition by src order by count desc, dst) as rank from counts where count >= 5) where rank <= 12""",
    "trajectory_quality": f"""{WITH}, u as (select *, case when ord >= 4 then ord end as o, label not like '%7' as known from steps
    ), r as (select split, count(*) as rows, count(distinct person) as people, count(*) filter (o is null) as invalid_orders, count(*) filter (coalesce(trim(label), '') = '') as missing_labels, count(distinct label) as labels,
      count(distinct label) filter (not known) as unmapped_labels, coalesce(string_agg(distinct label, ',' order by label) filter (not known), '') as unmapped from u group by split
    ), pos as (select split, person, o, min(label) as label, count(label) as n_rows, count(distinct label) as n from u where o is not null group by split, person, o
    ), c as (select split, count(*) as positions, count(*) filter (n = 1) as kept_positions, count(*) filter (n = 0) as empty_positions, coalesce(sum(n_rows - 1) filter (n = 1), 0)::bigint as exact_duplicates, count(*) filter (n > 1) as ambiguous_positions from pos group by split
    ), l as (select split, label as src, o, lead(label) over w as dst, lead(o) over w as next_o from pos where n = 1 window w as (partition by person order by o)
    ), p as (select split, src, dst, case when next_o <> o + 1 then 'gap' when src = dst then 'self' when src like '%7' or dst like '%7' then 'unmapped' else 'valid' end as reason from l where next_o is not null
    ), q as (select split, count(*) as pairs, count(*) filter (reason = 'gap') as gaps, count(*) filter (reason = 'self') as self_transitions, count(*) filter (reason = 'unmapped') as unmapped_transitions,
      count(*) filter (reason = 'valid') as valid_transitions, count(distinct (src, dst)) filter (reason = 'valid') as distinct_transitions from p group by split)
    select * from r join c using (split) join q using (split)""",
    "support_retention": f"""{CHAIN} select threshold, count(*) filter (count >= threshold) as edges, coalesce(sum(count) filter (count >= threshold), 0)::bigint as observations,
      round(coalesce(sum(count) filter (count >= threshold), 0) / sum(count), 6) as ratio from counts, (values (1), (2), (3), (5), (10), (25)) v(threshold) group by threshold""",
    "prefixes": f"{CHAIN}, {_PREFIX.format(src='kept')} select person, ord, array_to_string(history, '>') as history, target from prefixes where len(history) > 0",
    "second_order_prefixes": f"{CHAIN}, {_PREFIX.format(src='kept')}, {_SECOND} select * from second",
    "pretrain_prefixes": f"""{CHAIN}, usable as (select * from kept where label in (select dst from counts where count >= 5)
    ), squeezed as (select * from (select *, lag(label) over (partition by person order by ord) as before from usable) where before is null or before <> label
    ), p as (select person, ord, list(label) over (partition by person order by ord rows between unbounded preceding and 1 preceding) as history, label as target from squeezed)
    select person, ord, array_to_string(history, '>') as history, target from p where len(history) > 0""",
    "second_order_counts": f"""{CHAIN}, {_PREFIX.format(src="(select * from kept where split = 'train')")}, {_SECOND}
    select *, cast(sum(count) over (partition by previous, current) as bigint) as context_total from (select previous, current, dst, count(*) as count from second group by all)""",
    "history_cap": f"""{CHAIN}, squeezed as (select * from (select *, lag(label) over (partition by person order by ord, label) as before from kept) where before is null or before <> label
    ), h as (select person, list(label order by ord, label) as history from squeezed group by person)
    select person, array_to_string(history[-3:], '>') as history from h""",
    "fold_counts": f"""{CHAIN}, f as (select cast(cast('0x' || substr(sha256(cast(person as varchar)), 1, 8) as bigint) % 5 as int) as fold, src, dst from train_pairs
    ), c as (select fold, src, dst, count(*) as count from f group by all) select *, cast(sum(count) over (partition by src, dst) as bigint) - count as train_count from c""",
    "transition_context": f"""{CHAIN} select dst, sum(count)::bigint as dest_count, round(sum(count) / (select sum(count) from counts), 6) as popularity from counts group by dst""",
    "parse_quarter": f"""with {b.SQL_DATED} select {_Q.format(c='start_date')} as start, {_Q.format(c='end_date')} as "end", count(*) as count from dated group by all""",
    "dated_transitions": f"{_DATED} select src, dst, reason, count(*) as count, count(*) filter (overlap) as overlaps from pairs group by all",
    "dated_quality": f"""{_DATED}, m as (select * from staged where reason not in ('unknown', 'unmapped'))
      select (select count(*) from dated) as raw_rows, (select count(distinct resume_id) from dated) as raw_people, (select count(*) from dated) - (select count(*) from stages) as exact_duplicate_rows,
      (select count(*) from staged where reason = 'unknown') as unknown_code_rows, (select count(*) from staged where reason = 'unmapped') as unmapped_code_rows, (select string_agg(distinct code, ',' order by code) from staged where reason = 'unmapped') as unmapped_codes,
      (select count(*) from m where coalesce(trim(start_date), '') = '') as missing_start_dates, (select count(*) from m where coalesce(trim(end_date), '') = '') as missing_end_dates,
      (select count(*) from m where trim(start_date) <> '' and s is null) as invalid_start_dates, (select count(*) from m where trim(end_date) <> '' and e is null) as invalid_end_dates,
      (select count(*) from m where reason = 'range') as invalid_date_ranges, (select count(*) from m where reason = 'unordered') as unordered_rows, (select count(*) from dated_rows where bad_level) as invalid_education_rows,
      (select count(*) from dated_rows) as accepted_rows, (select count(distinct person) from dated_rows) as accepted_people,
      count(*) filter (reason = 'ambiguous') as ambiguous_same_start_pairs, count(*) filter (overlap) as overlapping_pairs, count(*) filter (reason = 'self') as self_transitions, count(*) filter (reason = 'valid') as valid_transitions,
      count(distinct (src, dst)) filter (reason = 'valid') as distinct_transition_pairs from pairs""",
    "overlap_flag": f"{_DATED} select person, count(*) filter (overlap) as overlaps, count(*) as pairs from pairs where reason <> 'ambiguous' group by person",
    "tenure_gap_buckets": f"""{_DATED}, g as (select *, lag(e) over (partition by person order by o, role, s asc nulls last, e asc nulls last, level) as before from dated_rows)
    select {_TEN.format(a='s', b='e')} as tenure, {_GAP.format(a='before', b='s')} as gap, {_EDU.format('level')} as education, count(*) as count from g group by all""",
    "feature_prefixes": f"{_FOLD} select person, n, array_to_string(history, '>') as history, target, tenure, gap, education from fp",
    "person_runs": """select person, count(*) filter (before is null or before <> person) as runs, count(*) as rows
      from (select person, lag(person) over (partition by y order by o_orderkey) as before from (select o_custkey // 100 as person, year(o_orderdate) as y, o_orderkey from orders)) group by person""",
    "feature_availability": f"{_FOLD} select count(*) as prefixes, count(*) filter (tenure = 0) as missing_tenure, count(*) filter (gap = 0) as missing_gap, count(*) filter (education <> 0) as with_education from fp",
    "out_of_order_people": """select distinct person from (select o_custkey as person, year(o_orderdate) * 4 + quarter(o_orderdate) as ord,
      lag(year(o_orderdate) * 4 + quarter(o_orderdate)) over (partition by o_custkey order by o_orderkey) as before from orders) where before > ord""",
    "split_disjointness": f"""{WITH}, by_split as (select distinct person, split from steps), names(n) as (values ('test'), ('train'), ('validation'))
    select a.n as first, b.n as second, (select count(*) from by_split x join by_split y using (person) where x.split = a.n and y.split = b.n) as people from names a join names b on a.n < b.n""",
    "distinct_rows": f"{WITH} select *, rows - distinct_rows as dropped from (select (select count(*) from steps) as rows, (select count(*) from (select distinct * from steps)) as distinct_rows)",
    "unmapped_labels": f"{WITH} select label, count(*) as rows from steps where label like '%7' group by label",
    "stable_fold": "select cast(cast('0x' || substr(sha256(cast(c_custkey as varchar)), 1, 8) as bigint) % 5 as int) as fold, count(*) as people from customer group by fold",
}
