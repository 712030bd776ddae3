"""Registered queries over labels in free text, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text as x
from ..sources import bridge as b
from .graph_queries import _NODES, full_edges, nodes, skills


def titled_skills(s, d):
    """Skills, every second of which says in parentheses what it is."""
    return skills(s, d).withColumn("title", F.when(F.length("title") % 2 == 0, F.concat("title", F.lit(" (Tool)"))).otherwise(F.col("title")))


def skill_aliases(s, d):
    return x.skill_aliases(titled_skills(s, d))


def phrases(s, d):
    """(query_id, phrase): what parts are called, with a word of proficiency, in capitals, or followed by nonsense."""
    k, name = F.col("p_partkey"), F.col("p_name")
    phrase = F.when(k % 5 == 0, F.concat(F.lit("Advanced "), name)).when(k % 5 == 1, F.upper(name)).when(k % 5 == 2, F.concat(name, F.lit(" xyz"))).when(k % 5 == 3, F.concat(F.lit("  "), name, F.lit(" (TOOL)"))).otherwise(F.lit(" "))
    return b.table(s, d, "part").select(k.alias("query_id"), phrase.alias("phrase"))


def alias_match(s, d):
    """Phrases with the alias that each is, judged by what its owner says."""
    return x.judged_phrases(phrases(s, d), skill_aliases(s, d), utterances(s, d)).select("query_id", "phrase", "alias", F.array_join("ids", "|").alias("ids"), "verdict")


def utterances(s, d):
    """(query_id, text): what each part's owner says of it: that they know it, don't, or want to learn the next one."""
    name, k = F.col("p_name"), F.col("p_partkey")
    after = F.element_at(F.split(name, " "), -1)
    text = F.concat(F.when(k % 7 == 0, F.lit("I do not know ")).when(k % 7 == 1, F.lit("")).otherwise(F.lit("I know ")), name, F.when(k % 7 == 1, F.lit("")).otherwise(F.concat(F.lit(". I want to learn red "), after, F.lit("!"))))
    return b.table(s, d, "part").select(k.alias("query_id"), text.alias("text"))


def owned_skill_mentions(s, d):
    return x.owned_mentions(utterances(s, d), skill_aliases(s, d))


def answers(s, d):
    """(query_id, text): an answer about each brand that names its part in bold, another role and something that is nowhere."""
    part = b.table(s, d, "part")
    other = F.concat(F.lit("Brand#"), (F.col("p_partkey") % 30 + 1).cast("string"))
    text = F.concat(F.lit("You could move from "), F.col("p_brand"), F.lit(' to "'), other, F.lit('" if you learn **'), F.initcap("p_name"), F.lit("** and Quantum Weaving."))
    return part.select(F.col("p_partkey").alias("query_id"), "p_brand", text.alias("text"))


def extract_entities(s, d):
    return x.extract_entities(answers(s, d))


def entity_match(s, d):
    """Entities as the parts' names and brands, some with a note in parentheses."""
    k = F.col("p_partkey")
    found = b.table(s, d, "part").select(k.alias("query_id"), F.explode(F.array(F.initcap("p_name"), F.concat("p_brand", F.when(k % 2 == 0, F.lit(" (new)")).otherwise(F.lit(""))))).alias("entity"))
    every = nodes(s, d).select("id", "type", "title").unionByName(titled_skills(s, d).select("id", "type", "title"))
    return x.match_entities(found, every)


def faithfulness(s, d):
    """What each answer names against the whole graph: edges of every relation and source, of every level of requirement."""
    a = answers(s, d)
    every = nodes(s, d).select("id", "type", "title").unionByName(skills(s, d).select("id", "type", "title"))
    return x.faithfulness(a.select("query_id", "text"), a.select("query_id", F.concat(F.lit("a:"), "p_brand").alias("id")), every, full_edges(s, d).select("src", "dst"))


def fuzzy_role_match(s, d):
    """Names of suppliers with a letter too many, one missing, or two changed, and brands as they are."""
    name, k = F.col("s_name"), F.col("s_suppkey")
    odd = F.when(k % 4 == 0, F.concat(name, F.lit("x"))).when(k % 4 == 1, F.concat(F.substring(name, 1, 3), F.substring(name, 5, 100))).when(k % 4 == 2, F.concat(F.lit("zz"), F.substring(name, 3, 100))).otherwise(F.upper(name))
    return x.resolve_roles(b.table(s, d, "supplier").select(odd.alias("phrase")), nodes(s, d).select("id", "title"))


QUERIES = {f.__name__: f for f in (skill_aliases, alias_match, owned_skill_mentions, extract_entities, entity_match, faithfulness, fuzzy_role_match)}

_ALIASES = "named as (select 's:' || n as id, n as label, length(n) % 2 = 0 as tool from (select distinct p_name as n from part)), aliases as (select label || case when tool then ' tool' else '' end as alias, id from named union select label, id from named)"
ORACLE_SQL = {
    "skill_aliases": f"with {_ALIASES} select * from aliases",
    "alias_match": f"""with {_ALIASES}, p as (
        select p_partkey as query_id, trim(case p_partkey % 5 when 0 then 'Advanced ' || p_name when 1 then upper(p_name) when 2 then p_name || ' xyz' when 3 then p_name || ' (TOOL)' else '' end) as phrase from part
      ), k as (select query_id, phrase, trim(regexp_replace(lower(phrase), '[^a-z0-9_]+', ' ', 'g')) as key from p where phrase <> ''
      ), t as (select query_id, phrase, 0 as n, key from k union all select query_id, phrase, 1, regexp_replace(key, '^advanced ', '') from k
      ), h as (select query_id, phrase, n, alias, string_agg(id, '|' order by id) as ids from t left join aliases on alias = key group by all
      ), m as (select query_id, phrase, arg_min(alias, n) filter (alias is not null) as alias, arg_min(ids, n) filter (alias is not null) as ids from h group by query_id, phrase)
      select *, case when alias is null then 'unmatched' when query_id % 7 = 0 or alias like '% tool' then 'excluded' else 'matched' end as verdict from m""",
    "owned_skill_mentions": "select p_partkey as query_id, p_name as alias, p_partkey % 7 <> 0 as owned from part where p_partkey % 7 <> 1",
    "entity_match": f"""with {_NODES}, e as (select p_partkey as query_id, array_to_string([upper(w[1]) || substr(w, 2) for w in string_split(p_name, ' ')], ' ') as entity, p_name as key from part
      union all select p_partkey, p_brand || case when p_partkey % 2 = 0 then ' (new)' else '' end, replace(lower(p_brand), '#', ' ') || case when p_partkey % 2 = 0 then ' new' else '' end from part
      ), ix as (select trim(regexp_replace(lower(title), '[^a-z0-9_]+', ' ', 'g')) as key, id, type from nodes union all select title, id, type from skills)
      select query_id, entity, id, type from e left join ix using (key)""",
}
