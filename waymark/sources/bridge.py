"""Views that give the star-schema tables the shapes of trajectories, a graph and its vectors.

Each view is a DataFrame over the given tables; SQL_* are the same views as common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@staged
def career_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(person, ord, label, split): a customer's orders as quarters, labelled by the first line's brand."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey"))["l_partkey"].alias("partkey"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    orders = table(spark, sf_dir, "orders")
    digit = F.col("o_custkey") % 10
    return (
        orders.join(first, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(part, F.col("partkey") == F.col("p_partkey"))
        .select(
            F.col("o_custkey").alias("person"),
            ((F.year("o_orderdate") - 1992) * 4 + F.quarter("o_orderdate") - 1).cast("long").alias("ord"),
            F.col("p_brand").alias("label"),
            F.when(digit <= 7, "train").when(digit == 8, "validation").otherwise("test").alias("split"),
        )
    )


SQL_STEPS = """first_line as (
  select l_orderkey, l_partkey from (select l_orderkey, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as n from lineitem) where n = 1
), steps as (
  select o_custkey as person, cast((year(o_orderdate) - 1992) * 4 + quarter(o_orderdate) - 1 as bigint) as ord, p_brand as label,
    case when o_custkey % 10 <= 7 then 'train' when o_custkey % 10 = 8 then 'validation' else 'test' end as split
  from orders join first_line on o_orderkey = l_orderkey join part on l_partkey = p_partkey
)"""


@staged
def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(person, ord, label): a user's events in order of time."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("person"), F.row_number().over(w).cast("long").alias("ord"), F.col("event_type").alias("label"))


SQL_EVENT_STEPS = """event_steps as (
  select user_id as person, row_number() over (partition by user_id order by ts, event_id) as ord, event_type as label from events
)"""


@staged
def dated_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(resume_id, matched_code, start_date, end_date, university_level): dated rows with quarters as text.

    The keys of the orders say where a date is missing or ill-formed, which rows occur twice and which
    education has an unknown spelling, so that every step of cleaning has something to do."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey"))["l_partkey"].alias("partkey"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    start = F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1
    end = start + (F.col("o_orderkey") % 5 - 1).cast("int")
    text = lambda q: F.concat(F.lit("Q"), (q % 4 + 1).cast("string"), F.lit(" "), F.floor(q / 4).cast("string"))
    level = F.element_at(F.array(*map(F.lit, LEVELS)), F.substring("o_orderpriority", 1, 1).cast("int"))
    key = F.col("o_orderkey")
    return (
        table(spark, sf_dir, "orders")
        .join(first, key == F.col("l_orderkey"))
        .join(part, F.col("partkey") == F.col("p_partkey"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(key % 23 == 0, 2).otherwise(1))))
        .select(
            F.col("o_custkey").alias("resume_id"),
            F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(F.col("p_brand")).alias("matched_code"),
            F.when(key % 17 == 0, "2000-Q1").when(key % 13 != 0, text(start)).alias("start_date"),
            F.when(key % 7 != 0, text(end)).alias("end_date"),
            F.when(key % 19 == 0, "Diploma").otherwise(level).alias("university_level"),
        )
    )


# Spellings of education levels, by the first digit of an order's priority.
LEVELS = ("PhD", "Master", "Bachelor", "Secondary school", "None")

SQL_DATED = SQL_STEPS.split("), steps")[0] + """), dated_raw as (
  select o_custkey as resume_id, case when o_orderstatus = 'P' then 'unknown' else p_brand end as matched_code, o_orderkey as k,
    year(o_orderdate) * 4 + quarter(o_orderdate) - 1 as s, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 + o_orderkey % 5 - 1 as e,
    ['PhD', 'Master', 'Bachelor', 'Secondary school', 'None'][cast(substr(o_orderpriority, 1, 1) as int)] as university_level
  from orders join first_line on o_orderkey = l_orderkey join part on l_partkey = p_partkey
), dated as (
  select resume_id, matched_code, case when k % 17 = 0 then '2000-Q1' when k % 13 <> 0 then 'Q' || (s % 4 + 1) || ' ' || (s // 4) end as start_date,
    case when k % 7 <> 0 then 'Q' || (e % 4 + 1) || ' ' || (e // 4) end as end_date, case when k % 19 = 0 then 'Diploma' else university_level end as university_level
  from dated_raw, unnest(range(case when k % 23 = 0 then 2 else 1 end))
)"""


def code_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, role): the role of each code; codes that end in 7 are left out on purpose, to be unmapped."""
    return roles_a(spark, sf_dir).filter("esco_code not like '%7'").select(F.col("esco_code").alias("code"), F.col("id").alias("role"))


@staged
def roles_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, type, source, title, isco_group, esco_code): a role a brand."""
    no = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    return table(spark, sf_dir, "part").select("p_brand").distinct().select(
        F.concat(F.lit("a:"), "p_brand").alias("id"), F.lit("role").alias("type"), F.lit("esco").alias("source"), F.col("p_brand").alias("title"),
        (1000 + (no * 137) % 900).cast("string").alias("isco_group"), F.col("p_brand").alias("esco_code"),
    )


SQL_ROLES_A = """roles_a as (
  select 'a:' || p_brand as id, 'role' as type, 'esco' as source, p_brand as title,
    cast(1000 + (cast(regexp_extract(p_brand, '(\\d+)$', 1) as int) * 137) % 900 as varchar) as isco_group, p_brand as esco_code
  from (select distinct p_brand from part)
)"""


@staged
def roles_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, type, source, title, isco_group, job_zone, typical_education_level): a role a supplier."""
    level = F.element_at(F.array(*map(F.lit, LEVELS)), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("b:"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("role").alias("type"), F.lit("onet").alias("source"), F.col("s_name").alias("title"),
        (10 + F.col("s_nationkey")).cast("string").alias("isco_group"), (1 + F.col("s_suppkey") % 5).cast("int").alias("job_zone"), level.alias("typical_education_level"),
    )


SQL_ROLES_B = """roles_b as (
  select 'b:' || s_suppkey as id, 'role' as type, 'onet' as source, s_name as title, cast(10 + s_nationkey as varchar) as isco_group,
    cast(1 + s_suppkey % 5 as int) as job_zone, ['PhD', 'Master', 'Bachelor', 'Secondary school', 'None'][cast(s_suppkey % 5 + 1 as int)] as typical_education_level
  from supplier
)"""


@staged
def requires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, relation, source, requirement_level, importance, level_score): roles and their skills."""
    part = table(spark, sf_dir, "part")
    a = (
        part.groupBy("p_brand", "p_name")
        .agg(F.min("p_partkey").alias("k"), F.avg("p_size").alias("size"))
        .filter("k % 3 <> 0")
        .select(
            F.concat(F.lit("a:"), "p_brand").alias("src"), F.concat(F.lit("s:"), "p_name").alias("dst"), F.lit("REQUIRES").alias("relation"), F.lit("esco").alias("source"),
            F.when(F.col("size") >= 25, "essential").otherwise("optional").alias("requirement_level"), F.lit(None).cast("double").alias("importance"), F.lit(None).cast("double").alias("level_score"),
        )
    )
    b = (
        table(spark, sf_dir, "lineitem")
        .join(part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_suppkey", "p_name")
        .agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("q"), F.sum(F.col("l_discount").cast("decimal(18,2)")).alias("d"), F.count("*").alias("n"))
        .select(
            F.concat(F.lit("b:"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("s:"), "p_name").alias("dst"), F.lit("REQUIRES").alias("relation"), F.lit("onet").alias("source"),
            F.lit(None).cast("string").alias("requirement_level"), F.round(F.col("q").cast("double") / F.col("n") / 8 + 1e-9, 2).alias("importance"), F.round(F.col("d").cast("double") / F.col("n") * 50 + 1e-9, 2).alias("level_score"),
        )
    )
    return a.unionByName(b)


SQL_REQUIRES = """requires as (
  select 'a:' || p_brand as src, 's:' || p_name as dst, 'REQUIRES' as relation, 'esco' as source,
    case when avg(p_size) >= 25 then 'essential' else 'optional' end as requirement_level, cast(null as double) as importance, cast(null as double) as level_score
  from part group by p_brand, p_name having min(p_partkey) % 3 <> 0
  union all
  select 'b:' || l_suppkey, 's:' || p_name, 'REQUIRES', 'onet', null,
    round(cast(sum(cast(l_quantity as decimal(18,2))) as double) / count(*) / 8 + 1e-9, 2), round(cast(sum(cast(l_discount as decimal(18,2))) as double) / count(*) * 50 + 1e-9, 2)
  from lineitem join part on l_partkey = p_partkey group by l_suppkey, p_name
)"""


@staged
def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vec): embeddings 1 to 25 for brands, from 100 on for suppliers."""
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("b:"), F.col("s_suppkey").cast("string")).alias("id"), (F.col("s_suppkey") + 100).alias("vec_id"))
    brands = roles_a(spark, sf_dir).select("id", F.regexp_extract("title", r"(\d+)$", 1).cast("long").alias("vec_id"))
    return brands.unionByName(suppliers).join(table(spark, sf_dir, "embeddings"), "vec_id").select("id", F.col("embedding").alias("vec"))


SQL_VECTORS = """vector_ids as (
  select id, cast(regexp_extract(title, '(\\d+)$', 1) as bigint) as vec_id from roles_a
  union all select 'b:' || s_suppkey, s_suppkey + 100 from supplier
), vectors as (select id, embedding as vec from vector_ids join embeddings using (vec_id))"""


# Titles of job zones by number; the fifth has none.
ZONES = {1: "little preparation", 2: "some", 3: "medium", 4: "considerable"}
SQL_ZONE = "case job_zone when 1 then 'little preparation' when 2 then 'some' when 3 then 'medium' when 4 then 'considerable' end"


def all_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, type, source, title): a skill a part name."""
    return table(spark, sf_dir, "part").select("p_name").distinct().select(F.concat(F.lit("s:"), "p_name").alias("id"), F.lit("skill").alias("type"), F.lit("esco").alias("source"), F.col("p_name").alias("title"))


@staged
def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, type, source, title, code): occupation groups, of two digits for nations and of four for roles; skill
    groups, one for each last word of a skill and one for all."""
    two = table(spark, sf_dir, "nation").select((10 + F.col("n_nationkey")).cast("string").alias("code"), F.col("n_name").alias("title"))
    four = roles_a(spark, sf_dir).select(F.col("isco_group").alias("code")).distinct().select("code", F.concat(F.lit("Group "), "code").alias("title"))
    a = two.unionByName(four).select(F.concat(F.lit("i:"), "code").alias("id"), F.lit("isco_group").alias("type"), F.lit("esco").alias("source"), "title", "code")
    noun = table(spark, sf_dir, "part").select(F.element_at(F.split("p_name", " "), -1).alias("title")).distinct().unionByName(spark.range(1).select(F.lit("all").alias("title")))
    z = noun.select(F.concat(F.lit("g:"), "title").alias("id"), F.lit("skill_group").alias("type"), F.lit("esco").alias("source"), "title", F.lit(None).cast("string").alias("code"))
    return a.unionByName(z)


def skill_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(level_0, level_1, level_2): the skills' hierarchy as level columns; gizmos have no middle level."""
    noun = F.element_at(F.split("title", " "), -1)
    return all_skills(spark, sf_dir).select(F.lit("g:all").alias("level_0"), F.when(noun != "gizmo", F.concat(F.lit("g:"), noun)).alias("level_1"), F.col("id").alias("level_2"))


def skill_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(skill, other, relation_type): of each skill with the red one of its kind."""
    one = all_skills(spark, sf_dir).select("id", F.element_at(F.split("title", " "), 1).alias("how"), F.element_at(F.split("title", " "), -1).alias("noun"))
    red = one.filter("how = 'red'").select(F.col("id").alias("other"), "noun")
    kind = F.when(F.col("how") == "old", "skill narrower than skill").when(F.col("how") == "hot", "http://data/model#Broader").otherwise("related")
    return one.filter("how <> 'red'").join(red, "noun").select(F.col("id").alias("skill"), "other", kind.alias("relation_type"))


SQL_TAXONOMY = f"""all_skills as (select distinct 's:' || p_name as id, 'skill' as type, 'esco' as source, p_name as title from part
), groups_ as (
  select 'i:' || (10 + n_nationkey) as id, 'isco_group' as type, 'esco' as source, n_name as title, cast(10 + n_nationkey as varchar) as code from nation
  union all select distinct 'i:' || isco_group, 'isco_group', 'esco', 'Group ' || isco_group, isco_group from roles_a
  union all select 'g:' || t, 'skill_group', 'esco', t, null from (select distinct split_part(p_name, ' ', -1) as t from part union all select 'all')
), kinds as (select id, split_part(title, ' ', 1) as how, split_part(title, ' ', -1) as noun from all_skills
), lv as (select 'g:all' as x, case when noun <> 'gizmo' then 'g:' || noun end as y, id as z from kinds
), tax as (
  select src, dst, 'REQUIRES' as relation, 'esco' as source, null as pillar, requirement_level from requires where source = 'esco'
  union all select a.id, g.id, 'BELONGS_TO', 'esco', null, null from roles_a a join groups_ g on g.code = a.isco_group
  union all select * from (with b(id, broader, pillar) as (
    select 'i:' || isco_group, 'i:' || substr(isco_group, 1, 2), null from (select distinct isco_group from roles_a)
    union all select id, 'i:' || isco_group, 'occupations' from roles_a
    union all select * from (select distinct y, x, 'skills' from lv where y is not null union all select distinct z, y, 'skills' from lv where y is not null)
  ) select id, broader, 'BROADER_THAN', 'esco', pillar, null from b union all select broader, id, 'NARROWER_THAN', 'esco', pillar, null from b)
  union all select a.id, r.id, case a.how when 'old' then 'NARROWER_THAN' else 'BROADER_THAN' end, 'esco', 'skills', null from kinds a join kinds r on r.noun = a.noun and r.how = 'red' where a.how in ('old', 'hot')
)"""
