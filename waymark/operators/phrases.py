"""Phrases of any length in texts by a token trie, and what texts say of them: owned, denied, or wished for.

A trie is a table of edges (node, word, next, ends); a node is the words on the way to it. Texts walk it
by joins, one word a step, from the places where some phrase begins, so neither all runs of words
nor all pairs of texts and phrases are ever made. Markers of claim, denial and wish are phrases
too, found by the same walk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import normalize_label

# By what words a text claims a skill, denies it, or wishes for it.
CLAIMS = (
    "i know", "i use", "i have", "i work with", "i worked with", "i am skilled in", "i am proficient in", "i am experienced in", "my skills are", "my skills include",
    "experience with", "experience in", "experienced in", "proficient in", "skilled in", "using", "know",
)
DENIALS = ("do not", "don t", "dont", "no", "not", "never", "without", "lack", "lacking", "need to learn", "want to learn")
WISHES = (
    "want", "wants", "hope", "hoping", "aim", "aiming", "goal", "interested", "move", "moving", "transition", "switch", "switching", "learn", "learning", "develop", "developing", "need", "needing", "aspire", "aspiring",
)
# Letters before a claim within which a denial voids it; words of a text that may list skills without a claim.
REACH, TERSE = 16, 10


def trie(phrases: DataFrame) -> DataFrame:
    """(node, word, next, ends) of phrases (phrase), normalised; ends: whether the way to `next` is a phrase."""
    words = phrases.select("phrase").distinct().select("phrase", F.split("phrase", " ").alias("w"))
    steps = words.select("phrase", "w", F.posexplode("w").alias("k", "word"))
    way = lambda n: F.array_join(F.slice("w", 1, n), " ")
    return steps.groupBy(way(F.col("k")).alias("node"), "word").agg(F.max(way(F.col("k") + 1)).alias("next"), F.max(F.col("k") + 1 == F.size("w")).alias("ends"))


def walk(texts: DataFrame, phrases: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, place, phrase) of every occurrence of a phrase in a text (ids, key), both normalised; place: the first word's number.

    The longest phrase's number of words, one number that is asked for, is the number of joins. A place that has
    left the trie keeps a node of its own, so those don't meet in one task."""
    edges = trie(phrases)
    depth = phrases.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 0
    none = F.array().cast("array<string>")
    words = texts.filter("key <> ''").select(*ids, F.split("key", " ").alias("w"))
    at = words.select(*ids, F.posexplode("w").alias("place", "word"), "w")
    roots = edges.filter("node = ''").select("word", F.col("next").alias("at"), "ends")
    rest = F.slice("w", F.col("place") + 2, max(1, depth - 1)) if depth > 1 else none
    state = at.join(roots, "word").select(*ids, "place", F.col("at"), rest.alias("rest"), F.when(F.col("ends"), F.array("at")).otherwise(none).alias("found"))
    deeper = edges.filter("node <> ''").select(F.col("node").alias("at"), F.col("word").alias("next_word"), "next", "ends")
    for k in range(depth - 1):
        gone = F.concat(F.lit("\u0000"), F.xxhash64(*ids, "place").cast("string"))
        state = state.withColumn("next_word", F.coalesce(F.get("rest", F.lit(k)), F.lit(""))).join(deeper, ["at", "next_word"], "left")
        state = state.select(*ids, "place", F.coalesce("next", gone).alias("at"), "rest", F.when(F.col("ends"), F.concat("found", F.array("next"))).otherwise(F.col("found")).alias("found"))
    return state.select(*ids, "place", F.explode("found").alias("phrase"))


def _markers(texts: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, kind, first, last): places of claims, denials and wishes in letters."""
    spark = texts.sparkSession
    rows = [(p, kind) for kind, of in (("claim", CLAIMS), ("denial", DENIALS), ("wish", WISHES)) for p in of]
    kinds = spark.createDataFrame(rows, "phrase string, kind string")
    return _in_letters(walk(texts, kinds.select("phrase"), ids), texts, ids).join(F.broadcast(kinds), "phrase").select(*ids, "kind", "first", "last")


def _in_letters(hits: DataFrame, texts: DataFrame, ids: list[str]) -> DataFrame:
    """hits with first and last, their place in letters of the normalised text."""
    before = F.array_join(F.slice(F.split("key", " "), 1, F.col("place")), " ")
    first = F.when(F.col("place") == 0, 0).otherwise(F.length(before) + 1)
    return hits.join(texts.select(*ids, "key"), ids).withColumn("first", first).withColumn("last", F.col("first") + F.length("phrase")).drop("key")


def owned_phrases(texts: DataFrame, phrases: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, phrase, owned) of the phrases (phrase, normalised) that each text (ids, text) names: whether one mention is owned.

    What stands last before a mention decides: a claim owns it, a denial or a wish doesn't, and of a claim and
    another that end together the other counts. A claim right behind a denial (REACH letters) counts for nothing. With no marker
    before it a mention is owned in a text of TERSE words or fewer. Markers and mentions of a text lie in one window, by
    where they end and begin."""
    t = texts.select(*ids, normalize_label(F.col("text")).alias("key")).filter("key is not null").distinct()
    marks = _markers(t, ids)
    mentions = _in_letters(walk(t, phrases.select("phrase"), ids), t, ids)
    order = Window.partitionBy(*ids).orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, -1)
    # denials before a claim: the one that begins last, of those that end where the claim begins or before
    ends = marks.filter("kind = 'denial'").select(*ids, F.col("last").alias("at"), F.lit(0).alias("turn"), F.lit("denial").alias("kind"), "first", "last")
    begins = marks.filter("kind = 'claim'").select(*ids, F.col("first").alias("at"), F.lit(1).alias("turn"), "kind", "first", "last")
    near = F.max(F.when(F.col("kind") == "denial", F.col("first"))).over(order)
    claims = ends.unionByName(begins).withColumn("near", near).filter("kind = 'claim'").filter(F.col("near").isNull() | (F.col("near") < F.col("first") - REACH))
    against = marks.filter("kind <> 'claim'").select(*ids, F.col("last").alias("at"), F.lit(0).alias("turn"), F.struct("last", F.lit(1).alias("against")).alias("mark"))
    for_ = claims.select(*ids, F.col("last").alias("at"), F.lit(0).alias("turn"), F.struct("last", F.lit(0).alias("against")).alias("mark"))
    said = mentions.select(*ids, F.col("first").alias("at"), F.lit(1).alias("turn"), "phrase")
    events = against.unionByName(for_).unionByName(said, allowMissingColumns=True)
    last = F.max("mark").over(order)
    short = t.select(*ids, (F.size(F.split("key", " ")) <= TERSE).alias("short"))
    judged = events.withColumn("deciding", last).filter("phrase is not null").join(short, ids)
    own = F.when(F.col("deciding").isNull(), F.col("short")).otherwise(F.col("deciding.against") == 0)
    return judged.groupBy(*ids, "phrase").agg(F.max(own).alias("owned"))


def claiming_clauses(texts: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, clause, key): the clauses of each text (ids, text) that hold a claim, normalised."""
    clause = texts.select(*ids, F.posexplode(F.split("text", r"[.;!?\n]+")).alias("clause", "part"))
    keyed = clause.select(*ids, "clause", normalize_label(F.col("part")).alias("key")).filter("key <> ''")
    padded = F.concat(F.lit(" "), "key", F.lit(" "))
    says = lambda p: padded.contains(f" {p} ")
    return keyed.filter(_any([says(p) for p in CLAIMS]))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out
