"""Metrics of rankings against held-out observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(scored: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """`scored` with rank by `order` within keys."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def heldout_metrics(predictions: DataFrame, held_out: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row of observation-weighted, covered-only and macro metrics and coverages.

    predictions: (src, dst, rank); held_out: (src, dst, count). Pairs that are not predicted add nothing."""
    covered = predictions.select("src").distinct().withColumn("covered", F.lit(True))
    w = Window.partitionBy("src").orderBy(F.desc("count"), "dst")
    pairs = held_out.select("src", "dst", "count").withColumn("ideal", F.row_number().over(w)).join(predictions.select("src", "dst", "rank"), ["src", "dst"], "left").join(covered, "src", "left")
    c, r, i = F.col("count"), F.col("rank"), F.col("ideal")
    aggs = [F.sum(c).alias("n"), F.max(F.coalesce("covered", F.lit(False))).alias("covered"), F.sum(F.coalesce(c / r, F.lit(0.0))).alias("rr"), F.sum(F.when(r.isNotNull(), c).otherwise(0)).alias("found")]
    for k in ks:
        aggs += [F.sum(F.when(r <= k, c).otherwise(0)).alias(f"h{k}"), F.sum(F.when(r <= k, c / F.log2(r + 1)).otherwise(0.0)).alias(f"dcg{k}"), F.sum(F.when(i <= k, c / F.log2(i + 1)).otherwise(0.0)).alias(f"idcg{k}")]
    by = pairs.groupBy("src").agg(*aggs)
    n, cov = F.sum("n"), F.sum(F.when(F.col("covered"), F.col("n")).otherwise(0))
    out = [n.alias("observations"), (F.sum("rr") / n).alias("mrr"), F.when(cov > 0, F.sum("rr") / cov).alias("covered_only_mrr"), F.avg(F.col("rr") / F.col("n")).alias("macro_mrr"),
           F.avg(F.col("covered").cast("int")).alias("source_role_coverage"), (cov / n).alias("observation_coverage"), (F.sum("found") / n).alias("destination_coverage")]
    for k in ks:
        ndcg = F.col(f"dcg{k}") / F.col(f"idcg{k}")
        out += [(F.sum(f"h{k}") / n).alias(f"hits_{k}"), F.when(cov > 0, F.sum(f"h{k}") / cov).alias(f"covered_only_hits_{k}"), F.avg(F.col(f"h{k}") / F.col("n")).alias(f"macro_hits_{k}"),
                (F.sum(ndcg * F.col("n")) / n).alias(f"ndcg_{k}"), F.avg(ndcg).alias(f"macro_ndcg_{k}")]
    return by.agg(*out)


def metrics_by(predictions: DataFrame, held: DataFrame, keys: list[str], held_keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, held_keys, mrr, hits_5, hits_10, macro_mrr, source_role_coverage, observation_coverage, destination_coverage) of
    predictions (keys, src, dst, rank) against held (held_keys, src, dst, count), weighted by observations: many rankings and
    many splits in one pass. Keys without a covered source have no row; held_keys are few."""
    own = held.select(*held_keys, "src", "dst", "count")
    of = own.groupBy(*held_keys, "src").agg(F.sum("count").alias("of"))
    total = own.groupBy(*held_keys).agg(F.sum("count").alias("n"), F.countDistinct("src").alias("sources"))
    hit = predictions.select(*keys, "src", "dst", "rank").join(own, ["src", "dst"])
    at = [F.sum(F.when(F.col("rank") <= k, F.col("count")).otherwise(0)).alias(f"h{k}") for k in (5, 10)]
    by = hit.groupBy(*keys, *held_keys, "src").agg(F.sum(F.col("count") / F.col("rank")).alias("rr"), *at, F.sum("count").alias("found"))
    seen = predictions.select(*keys, "src").distinct().join(of, "src").join(by, [*keys, *held_keys, "src"], "left").na.fill(0, ["rr", "h5", "h10", "found"])
    m = seen.groupBy(*keys, *held_keys).agg(
        *(F.sum(c).alias(c) for c in ("rr", "h5", "h10", "found")), F.sum(F.col("rr") / F.col("of")).alias("macro"), F.count("*").alias("covered"), F.sum("of").alias("reached")
    )
    j = m.join(F.broadcast(total), list(held_keys) or F.lit(True))
    names = {"mrr": ("rr", "n"), "hits_5": ("h5", "n"), "hits_10": ("h10", "n"), "macro_mrr": ("macro", "sources"), "source_role_coverage": ("covered", "sources"), "observation_coverage": ("reached", "n"), "destination_coverage": ("found", "n")}
    return j.select(*keys, *held_keys, *(F.round(F.col(a) / F.col(b), 9).alias(c) for c, (a, b) in names.items()))


def event_values(events: DataFrame, predictions: DataFrame, k: int = 10) -> DataFrame:
    """(person, rr, hit, ndcg, covered) of each event (person, src, target) by the rank of its target.

    covered says whether anything at all is predicted for the event's source."""
    p = predictions.select("src", F.col("dst").alias("target"), "rank")
    some = predictions.select("src").distinct().withColumn("some", F.lit(True))
    j = events.join(p, ["src", "target"], "left").join(some, "src", "left")
    hit = F.col("rank") <= k
    return j.select("person", F.coalesce(1 / F.col("rank"), F.lit(0.0)).alias("rr"), F.when(hit, 1.0).otherwise(0.0).alias("hit"), F.when(hit, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0).alias("ndcg"), F.col("some").isNotNull().alias("covered"))


def draw(person: Column, replicate: Column) -> Column:
    """Times that a person is drawn in a replicate: a Poisson(1) variate from a hash of both."""
    u = (F.conv(F.substring(F.sha2(F.concat(person.cast("string"), F.lit(":"), replicate.cast("string")), 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.when(u < 0.36787944117144233, 0).when(u < 0.7357588823428847, 1).when(u < 0.9196986029286058, 2).when(u < 0.9810118431238462, 3).when(u < 0.9963401531726563, 4).when(u < 0.9994058151824183, 5).otherwise(6)


def person_bootstrap(values: DataFrame, column: str, replicates: int = 200) -> DataFrame:
    """(mean, low, high): the event-weighted mean and its 2.5 and 97.5 percentiles over replicates
    that draw whole people."""
    people = values.groupBy("person").agg(F.sum(column).alias("s"), F.count("*").alias("n"))
    each = people.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("b")).withColumn("t", draw(F.col("person"), F.col("b")))
    means = each.groupBy("b").agg((F.sum(F.col("t") * F.col("s")) / F.sum(F.col("t") * F.col("n"))).alias("m"))
    cut = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return people.agg((F.sum("s") / F.sum("n")).alias("mean")).crossJoin(cut)


def paired_bootstrap(before: DataFrame, after: DataFrame, columns: tuple[str, ...], replicates: int = 200) -> DataFrame:
    """(metric, gain, low, high, better): what `after` adds to `before`, event values (person, *columns) of the same events, with the
    2.5 and 97.5 percentiles and the share of replicates in which it's more. Both are drawn alike: a replicate draws people
    with all their events of either side."""
    sums = lambda df: df.groupBy("person").agg(*[F.sum(c).alias(c) for c in columns], F.count("*").alias("n"))
    a = sums(before)
    z = sums(after).select("person", *[F.col(c).alias(f"z_{c}") for c in columns])
    people = a.join(z, "person").select("person", "n", *[(F.col(f"z_{c}") - F.col(c)).alias(c) for c in columns])
    each = people.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("b")).withColumn("t", F.when(F.col("b") == 0, 1).otherwise(draw(F.col("person"), F.col("b"))))
    # replicate 0 is the sample itself
    means = each.groupBy("b").agg(*[(F.sum(F.col("t") * F.col(c)) / F.sum(F.col("t") * F.col("n"))).alias(c) for c in columns])
    rows = means.select("b", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("m")) for c in columns])).alias("x")).select("b", "x.*")
    drawn = F.when(F.col("b") > 0, F.col("m"))
    return rows.groupBy("metric").agg(F.max(F.when(F.col("b") == 0, F.col("m"))).alias("gain"), F.percentile(drawn, F.lit(0.025)).alias("low"), F.percentile(drawn, F.lit(0.975)).alias("high"), F.avg((drawn > 0).cast("double")).alias("better"))


def source_ranking_metrics(scored: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row over sources with a positive: Hits and MRR of the first positive, binary NDCG at 5 and 10.

    scored: (src, dst, score, label); ties go to the smaller dst."""
    r = ranked(scored, ["src"], F.desc("score"), F.col("dst"))
    gain = lambda k: F.sum(F.when((F.col("label") == 1) & (F.col("rank") <= k), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    by = r.groupBy("src").agg(F.min(F.when(F.col("label") == 1, F.col("rank"))).alias("first"), F.count_if(F.col("label") == 1).alias("positives"), gain(5).alias("d5"), gain(10).alias("d10")).filter("positives > 0")
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.col("positives"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return by.agg(F.count("*").alias("sources"), F.avg(1 / F.col("first")).alias("mrr"), *[F.avg((F.col("first") <= k).cast("double")).alias(f"hits_{k}") for k in ks], F.avg(F.col("d5") / ideal(5)).alias("ndcg_5"), F.avg(F.col("d10") / ideal(10)).alias("ndcg_10"))


def auc(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, auc, ap) of (keys, score, label) by average ranks and by precision at distinct scores.

    Counts by score come first, so windows run over distinct scores and not over rows."""
    by = scored.groupBy(*keys, "score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    up = Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    x = by.withColumn("below", F.coalesce(F.sum("n").over(up), F.lit(0))).withColumn("tp", F.sum("p").over(down)).withColumn("all", F.sum(F.col("p") + F.col("n")).over(down))
    pos, neg = F.sum("p"), F.sum("n")
    return x.groupBy(*keys).agg(
        F.when((pos > 0) & (neg > 0), F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)) / (pos * neg)).alias("auc"), F.when(pos > 0, F.sum(F.col("p") * F.col("tp") / F.col("all")) / pos).alias("ap")
    )


def band_thresholds(scores: DataFrame, column: str) -> DataFrame:
    """(low, high): the thirds of the finite scores within [0, 1], the second at least a millionth above the
    first where there is room. Fails with fewer than three scores."""
    c = F.col(column)
    q = scores.filter(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))).agg(F.percentile(column, F.lit(1.0 / 3)).alias("a"), F.percentile(column, F.lit(2.0 / 3)).alias("b"), F.count(column).alias("n"))
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    low = F.when(F.col("n") >= 3, unit(F.col("a"))).otherwise(F.raise_error(F.lit("three scores are needed")).cast("double"))
    high = unit(F.col("b"))
    return q.select(low.alias("low"), F.when(high > unit(F.col("a")), high).otherwise(F.least(F.lit(1.0), unit(F.col("a")) + 1e-6)).alias("high"))


def counted_before(asked: DataFrame, lists: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """asked with before: how many rows of `lists` with equal keys come strictly before it in `order`.

    Both lie in one window, those asked for ahead of rows of equal order, and the rows passed are counted on the way:
    nothing is collected, so a list may have any length."""
    one = asked.select("*", F.lit(0).alias("_counts"))
    both = one.unionByName(lists.select(*keys, *order, F.lit(1).alias("_counts")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(*order, "_counts").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("before", F.sum("_counts").over(w)).filter("_counts = 0").drop("_counts")


def inversions(rows: DataFrame, keys: list[str], place: str, value: str, bits: int = 40) -> DataFrame:
    """(keys, inversions): pairs of rows of which the one at the later place has the greater value.

    Values become ranks, equal ones alike. Two ranks part at one bit, the highest in which they differ; so for every bit
    the rows that agree above it are passed in order of place, and each with a 1 there counts those with a 0 before it.
    That is a row a row and bit up to the number of the list's ranks, in one window, and no list is held."""
    dense = rows.select(*keys, place, F.dense_rank().over(Window.partitionBy(*keys).orderBy(value)).alias("v")).withColumn("of", F.max("v").over(Window.partitionBy(*keys)))
    each = dense.withColumn("bit", F.explode(F.sequence(F.lit(0), F.least(F.lit(bits), F.floor(F.log2("of")).cast("int")))))
    high, one = F.expr("shiftright(v, bit + 1)"), F.expr("shiftright(v, bit) & 1")
    w = Window.partitionBy(*keys, "bit", "high").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    passed = each.withColumn("high", high).withColumn("one", one).withColumn("zeros", F.coalesce(F.sum(1 - F.col("one")).over(w), F.lit(0)))
    return passed.groupBy(*keys).agg(F.sum(F.col("one") * F.col("zeros")).alias("inversions"))


def ordering_inversions(cases: DataFrame, ranking: DataFrame, top: int = 3) -> DataFrame:
    """(case, n, inversions, top_mean, monotone): pairs of a case's ranking whose later one is more accessible.

    cases: (case), all to be reported; ranking: (case, rank, accessibility). Unknown accessibilities are left
    out of pairs and means."""
    known = ranking.filter("accessibility is not null")
    pairs = inversions(known, ["case"], "rank", "accessibility")
    by = known.groupBy("case").agg(F.count("*").alias("n"), F.avg(F.when(F.col("rank") <= top, F.col("accessibility"))).alias("top_mean")).join(pairs, "case", "left")
    out = cases.select("case").distinct().join(by.select("case", "n", "inversions", "top_mean"), "case", "left").na.fill(0, ["n", "inversions"])
    return out.withColumn("monotone", F.col("inversions") == 0)


def candidate_positions(observed: DataFrame, predictions: DataFrame, candidates: DataFrame) -> DataFrame:
    """(src, dst, rank) of observed pairs in the full ranking of all candidates but the source, which comes last.

    predictions: (src, dst, rank) come first, all other candidates behind them by id. A candidate without a
    score stands behind those with one and behind the lesser ids that have none, so its place is counted
    along the source's own list; sources and candidates are not multiplied. candidates: (dst), the ids."""
    # the candidates are the roles of a graph; their ids alone are numbered in one task
    place = candidates.select("dst").distinct().withColumn("pos", F.row_number().over(Window.orderBy("dst")))
    total = place.agg(F.count("*").alias("total"))
    lists = predictions.filter("src <> dst").join(place, "dst").select("src", "pos")
    own = place.select(F.col("dst").alias("src"), F.col("pos").alias("own"))
    size = lists.groupBy("src").agg(F.count("*").alias("scored"))
    asked = counted_before(observed.select("src", "dst").distinct().join(place, "dst"), lists, ["src"], ["pos"])
    j = asked.join(predictions.select("src", "dst", "rank"), ["src", "dst"], "left").join(size, "src", "left").join(own, "src", "left").crossJoin(F.broadcast(total))
    behind = F.coalesce("scored", F.lit(0)) + F.col("pos") - F.col("before") - F.coalesce((F.col("own") < F.col("pos")).cast("int"), F.lit(0))
    rank = F.when(F.col("src") == F.col("dst"), F.col("total")).when(F.col("rank").isNotNull(), F.col("rank")).otherwise(behind)
    return j.select("src", "dst", rank.cast("long").alias("rank"))


def acceptance(metrics: DataFrame) -> DataFrame:
    """(accepted, reasons) of one row of mrr, hits and coverage, before_* and after_*: better mrr, one
    better Hits, and no loss of coverage."""
    reasons = F.filter(
        F.array(
            F.when(F.col("after_mrr") <= F.col("before_mrr"), "mrr does not improve"),
            F.when((F.col("after_hits_5") <= F.col("before_hits_5")) & (F.col("after_hits_10") <= F.col("before_hits_10")), "no hits improve"),
            F.when(F.col("after_coverage") < F.col("before_coverage"), "coverage is lost"),
        ),
        lambda x: x.isNotNull(),
    )
    return metrics.select((F.size(reasons) == 0).alias("accepted"), F.array_join(reasons, "; ").alias("reasons"))
