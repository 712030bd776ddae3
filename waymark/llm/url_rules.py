"""URL filters: a sort-merge range join of urls with nested rules, in DataFrame functions only.

A host is turned round and its labels closed with a separator, so that a rule's host becomes an
interval of keys that holds the host and all its subdomains. Interval ends and urls are sorted
together; a sweep keeps the stack of rules whose interval is open. Intervals of hosts are nested,
so the stack behind an end is known from the rules alone and the sweep is the last stack in sort
order. Of the stack, the longest rule whose path begins the url's path decides.

The sweep runs in many salts, each with all interval ends and an even share of the urls: neither
a hot host nor a hot domain meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Salts for a shuffle partition: with several, hashing deals them evenly.
SALTS = 6


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first :// up to /, ?, # or the end, A-Z lowered; path: from there up to ?, #
    or the end. Both are empty for null urls and urls without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + F.lit(3), F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def host_key(host: Column) -> Column:
    """Labels in reverse, each closed by \\x01."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "\x01"), F.lit("\x01"))


def _ends(rules: DataFrame) -> DataFrame:
    """(key, kind, stack): the ends of the rules' intervals; kind 0 closes, 1 opens. stack: the rules
    that are open behind the end."""
    own = rules.groupBy("host").agg(F.collect_set(F.struct("path", "rule", "verdict")).alias("rules"))
    labels = F.split("host", r"\.", -1)
    # of a host: itself and all hosts above it that have rules
    above = own.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("up"))
    lines = above.join(own.withColumnRenamed("host", "up"), "up").select("host", "up", F.explode("rules").alias("r"))
    entry = F.struct(F.col("up").alias("host"), "r.path", "r.rule", "r.verdict")
    opened = lines.groupBy("host").agg(F.collect_list(entry).alias("stack"))
    key = host_key(F.col("host"))
    closed_key = F.concat(key.substr(F.lit(1), F.length(key) - 1), F.lit("\x02"))
    return opened.select(key.alias("key"), F.lit(1).alias("kind"), "stack").unionByName(
        opened.select(closed_key.alias("key"), F.lit(0).alias("kind"), F.filter("stack", lambda r: r["host"] != F.col("host")).alias("stack"))
    )


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of `pages`.

    rules: (host, path, verdict) with verdict allow or block; a rule fits its host and all
    subdomains if the url's path starts with the rule's path. The longest fitting rule wins; of
    equally long ones the first in order, and of two alike that differ in verdict, block. rule is
    null and the verdict `otherwise` where none fits, as for null and empty urls. Null rule hosts
    are skipped, null paths count as empty. Repeated rows and null ids give a row each.

    One shuffle, of (id, host, path, key), dealt by a salt of the row's place; rules are repeated for each
    salt, so their bytes times salts should stay below those of the urls."""
    spark = pages.sparkSession
    salts = max(1, SALTS * parts(spark))
    clean = rules.filter(F.col("host").isNotNull()).select(
        F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    )
    clean = clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("rule", F.concat("host", "path"))
    id_type = pages.schema[id_col].dataType
    ends = _ends(clean).select(
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"), "key", "kind", "stack",
        F.lit(None).cast(id_type).alias(id_col), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"),
    )
    host, path = host_and_path(F.col(url_col))
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int")
    urls = pages.select(salt.alias("_salt"), F.col(id_col), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host"))).withColumn("kind", F.lit(2)).withColumn("stack", F.lit(None).cast(ends.schema["stack"].dataType))
    sweep = Window.partitionBy("_salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = ends.unionByName(urls).withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).filter("kind = 2")
    fits = F.filter(
        F.col("open"),
        lambda r: (F.col("path").startswith(r["path"])) & ((F.col("host") == r["host"]) | F.col("host").endswith(F.concat(F.lit("."), r["host"]))),
    )
    best = F.element_at(F.array_sort(F.transform(fits, lambda r: F.struct((-F.length(r["rule"])).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))), 1)
    found = F.when(F.size(fits) > 0, best)
    return swept.select(id_col, "host", "path", found["rule"].alias("rule"), F.coalesce(found["verdict"], F.lit(otherwise)).alias("verdict"))
