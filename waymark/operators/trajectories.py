"""Cleaning of ordered histories, transitions and prefixes.

All of it partitions by person, so position collapse, pairing and prefixes share one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collapse_positions(steps: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(person, ord, *keys, label, n_rows, n_labels): one row a position; null labels are not counted.

    A position with one label is kept, with more it is ambiguous, with none it is empty."""
    return steps.groupBy("person", "ord", *keys).agg(F.min("label").alias("label"), F.count("label").alias("n_rows"), F.countDistinct("label").alias("n_labels"))


def kept_positions(steps: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return collapse_positions(steps, keys).filter("n_labels = 1")


def classified_pairs(positions: DataFrame, mapped: Column | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(person, *keys, ord, src, dst, reason): each kept position with the next one of its person.

    reason, by the first that holds: gap (not the next position), self (same label), unmapped, valid.
    mapped: a condition on src and dst; none means that every label is known."""
    w = Window.partitionBy("person").orderBy("ord")
    pairs = positions.withColumn("next_ord", F.lead("ord").over(w)).withColumn("dst", F.lead("label").over(w)).filter("next_ord is not null")
    pairs = pairs.withColumnRenamed("label", "src")
    reason = F.when(F.col("next_ord") != F.col("ord") + 1, "gap").when(F.col("src") == F.col("dst"), "self")
    if mapped is not None:
        reason = reason.when(~mapped, "unmapped")
    return pairs.select("person", *keys, "ord", "src", "dst", reason.otherwise("valid").alias("reason"))


def transitions(steps: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(person, *keys, ord, src, dst): valid transitions."""
    return classified_pairs(kept_positions(steps, keys), keys=keys).filter("reason = 'valid'").drop("reason")


def transition_counts(pairs: DataFrame, min_support: int = 1) -> DataFrame:
    """(src, dst, count, source_total, probability). The total is taken before the support filter."""
    total = F.sum("count").over(Window.partitionBy("src"))
    counted = pairs.groupBy("src", "dst").count().withColumn("source_total", total)
    return counted.withColumn("probability", F.col("count") / F.col("source_total")).filter(F.col("count") >= min_support)


def quality(steps: DataFrame, index: DataFrame) -> DataFrame:
    """One row a split: counters of what is read, of what cleaning does with it, and the labels in no index.

    steps: (person, ord, label, split), ord null where it isn't a number; index: (label)."""
    known = steps.join(index.select("label").distinct().withColumn("known", F.lit(True)), "label", "left")
    read = known.groupBy("split").agg(
        F.count("*").alias("rows"), F.countDistinct("person").alias("people"), F.count_if(F.col("ord").isNull()).alias("invalid_orders"), F.count_if(F.coalesce(F.trim("label"), F.lit("")) == "").alias("missing_labels"),
        F.countDistinct("label").alias("labels"), F.countDistinct(F.when(F.col("known").isNull(), F.col("label"))).alias("unmapped_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("known").isNull(), F.col("label")))), ",").alias("unmapped"),
    )
    positions = collapse_positions(steps.filter("ord is not null"), ("split",))
    of = positions.groupBy("split").agg(
        F.count("*").alias("positions"), F.count_if(F.col("n_labels") == 1).alias("kept_positions"), F.count_if(F.col("n_labels") == 0).alias("empty_positions"),
        F.sum(F.when(F.col("n_labels") == 1, F.col("n_rows") - 1).otherwise(0)).alias("exact_duplicates"), F.count_if(F.col("n_labels") > 1).alias("ambiguous_positions"),
    )
    ids = index.select(F.col("label").alias("known_label")).distinct()
    pairs = classified_pairs(positions.filter("n_labels = 1"), keys=("split",))
    pairs = pairs.join(ids, pairs["src"] == ids["known_label"], "left").withColumnRenamed("known_label", "a").join(ids, F.col("dst") == F.col("known_label"), "left")
    reason = F.when((F.col("reason") == "valid") & (F.col("a").isNull() | F.col("known_label").isNull()), "unmapped").otherwise(F.col("reason"))
    by = pairs.withColumn("reason", reason).groupBy("split").agg(
        F.count("*").alias("pairs"), *[F.count_if(F.col("reason") == r).alias(n) for r, n in (("gap", "gaps"), ("self", "self_transitions"), ("unmapped", "unmapped_transitions"), ("valid", "valid_transitions"))],
        F.countDistinct(F.when(F.col("reason") == "valid", F.struct("src", "dst"))).alias("distinct_transitions"),
    )
    return read.join(of, "split").join(by, "split")


def support_retention(counts: DataFrame, thresholds: tuple[int, ...] = (1, 2, 3, 5, 10, 25)) -> DataFrame:
    """(threshold, edges, observations, ratio) of counted pairs that reach each threshold."""
    each = counts.select("count", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    hit = F.col("count") >= F.col("threshold")
    out = each.groupBy("threshold").agg(F.count_if(hit).alias("edges"), F.coalesce(F.sum(F.when(hit, F.col("count"))), F.lit(0)).alias("observations"), F.sum("count").alias("all"))
    return out.select("threshold", "edges", "observations", (F.col("observations") / F.col("all")).alias("ratio"))


def prefixes(positions: DataFrame, gap_breaks: bool = True) -> DataFrame:
    """(person, ord, history, target): what came before each label within an unbroken stretch.

    A gap starts the history anew (if gap_breaks); a label equal to the one before it is skipped."""
    w = Window.partitionBy("person").orderBy("ord")
    new = F.lag("ord").over(w).isNull() | (F.lag("ord").over(w) != F.col("ord") - 1) if gap_breaks else F.lag("ord").over(w).isNull()
    island = positions.withColumn("island", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy("person", "island").orderBy("ord")
    distinct = island.withColumn("before", F.lag("label").over(inner)).filter("before is null or before <> label")
    history = F.collect_list("label").over(inner.rowsBetween(Window.unboundedPreceding, -1))
    return distinct.select("person", "ord", history.alias("history"), F.col("label").alias("target")).filter(F.size("history") > 0)


def second_order(prefixes: DataFrame) -> DataFrame:
    """(person, ord, previous, current, dst) of prefixes with two labels or more before the target."""
    n = F.size("history")
    return prefixes.filter(n >= 2).select("person", "ord", F.element_at("history", -2).alias("previous"), F.element_at("history", -1).alias("current"), F.col("target").alias("dst"))


def history_cap(steps: DataFrame, most: int = 10) -> DataFrame:
    """(person, history): the last `most` labels, consecutive duplicates removed."""
    w = Window.partitionBy("person").orderBy("ord", "label")
    kept = steps.withColumn("before", F.lag("label").over(w)).filter("before is null or before <> label")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "label"))), lambda x: x["label"])
    return kept.groupBy("person").agg(ordered.alias("all")).select("person", F.when(F.size("all") > most, F.slice("all", -most, most)).otherwise(F.col("all")).alias("history"))


def stable_fold(person: Column, folds: int) -> Column:
    """Fold of a person by a hash of the id: the same on every engine and run."""
    return (F.conv(F.substring(F.sha2(person.cast("string"), 256), 1, 8), 16, 10).cast("long") % folds).cast("int")


def fold_counts(pairs: DataFrame, folds: int = 5) -> DataFrame:
    """(fold, src, dst, count, train_count): pairs of each person fold, and those of all other folds."""
    counted = pairs.withColumn("fold", stable_fold(F.col("person"), folds)).groupBy("fold", "src", "dst").count()
    total = F.sum("count").over(Window.partitionBy("src", "dst"))
    return counted.withColumn("train_count", total - F.col("count"))


def transition_context(counts: DataFrame) -> DataFrame:
    """(dst, dest_count, popularity): how often each destination is reached."""
    by = counts.groupBy("dst").agg(F.sum("count").alias("dest_count"))
    return by.crossJoin(F.broadcast(counts.agg(F.sum("count").alias("total")))).select("dst", "dest_count", (F.col("dest_count") / F.col("total")).alias("popularity"))


def parse_quarter(text: Column) -> Column:
    """"Q3 2001" as year * 4 + quarter - 1; null where it isn't of that form."""
    m = r"^Q([1-4])\s+(\d{4})$"
    return F.when(text.rlike(m), F.regexp_extract(text, m, 2).cast("int") * 4 + F.regexp_extract(text, m, 1).cast("int") - 1)


# Accepted spellings of education levels, and their order.
EDUCATION = {"None": "None", "Secondary": "Secondary", "Secondary school": "Secondary", "Bachelor": "Bachelor", "Master": "Master", "PhD": "PhD"}
EDUCATION_ORDER = ("None", "Secondary", "Bachelor", "Master", "PhD")


def dated_stages(dated: DataFrame, index: DataFrame) -> DataFrame:
    """The distinct rows of `dated` (resume_id, matched_code, start_date, end_date, university_level) with
    what cleaning finds out about each.

    index: (code, role), one role a code. reason, by the first that holds: unknown (no code), unmapped (not in
    the index), range (ends before it starts), unordered (no date), accepted. order is the start or else
    the end; a date is missing if blank and invalid if not of the form "Q1 2000"; an education level of another
    spelling counts as None."""
    rows = dated.select("resume_id", "matched_code", "start_date", "end_date", "university_level").distinct()
    rows = rows.withColumn("code", F.trim(F.coalesce("matched_code", F.lit("")))).join(index.select("code", "role"), "code", "left")
    rows = rows.withColumn("start", parse_quarter(F.trim("start_date"))).withColumn("end", parse_quarter(F.trim("end_date")))
    missing = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    level = F.create_map(*[F.lit(x) for pair in EDUCATION.items() for x in pair])[F.trim("university_level")]
    reason = (
        F.when((F.col("code") == "") | (F.lower("code") == "unknown"), "unknown")
        .when(F.col("role").isNull(), "unmapped")
        .when(F.col("end") < F.col("start"), "range")
        .when(F.col("start").isNull() & F.col("end").isNull(), "unordered")
        .otherwise("accepted")
    )
    return rows.select(
        F.col("resume_id").alias("person"), "code", "role", F.coalesce("start", "end").alias("order"), "start", "end", F.coalesce(level, F.lit("None")).alias("university_level"), reason.alias("reason"),
        missing("start_date").alias("missing_start"), missing("end_date").alias("missing_end"), (~missing("start_date") & F.col("start").isNull()).alias("invalid_start"), (~missing("end_date") & F.col("end").isNull()).alias("invalid_end"),
        level.isNull().alias("invalid_education"),
    )


def dated_rows(dated: DataFrame, index: DataFrame) -> DataFrame:
    """The accepted rows: (person, code, role, order, start, end, university_level)."""
    return dated_stages(dated, index).filter("reason = 'accepted'").select("person", "code", "role", "order", "start", "end", "university_level")


def dated_pairs(rows: DataFrame) -> DataFrame:
    """(person, src, dst, reason, overlap): neighbours by (order, end, code, role). Of equal order they are
    ambiguous; of the others, an overlap (the next starts before this ends) is marked and the pair kept."""
    w = Window.partitionBy("person").orderBy("order", F.asc_nulls_last("end"), "code", "role", "start", "university_level")
    near = rows.select("person", F.col("role").alias("src"), "order", "end", F.lead("role").over(w).alias("dst"), F.lead("order").over(w).alias("next_order"), F.lead("start").over(w).alias("next_start")).filter("next_order is not null")
    reason = F.when(F.col("next_order") == F.col("order"), "ambiguous").when(F.col("src") == F.col("dst"), "self").otherwise("valid")
    overlap = (F.col("next_order") != F.col("order")) & F.coalesce(F.col("next_start") < F.col("end"), F.lit(False))
    return near.select("person", "src", "dst", reason.alias("reason"), overlap.alias("overlap"))


def dated_quality(dated: DataFrame, index: DataFrame) -> DataFrame:
    """One row of counters over all steps of cleaning, and the codes that are in no index.

    Dates are counted over mapped rows, education over rows that have an order."""
    raw = dated.agg(F.count("*").alias("raw_rows"), F.countDistinct("resume_id").alias("raw_people"))
    each = dated_stages(dated, index)
    is_ = lambda r: F.count_if(F.col("reason") == r)
    mapped = ~F.col("reason").isin("unknown", "unmapped")
    found = each.agg(
        F.count("*").alias("distinct_rows"), is_("unknown").alias("unknown_code_rows"), is_("unmapped").alias("unmapped_code_rows"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("reason") == "unmapped", F.col("code")))), ",").alias("unmapped_codes"),
        *[F.count_if(mapped & F.col(c)).alias(f"{c}_dates") for c in ("missing_start", "missing_end", "invalid_start", "invalid_end")],
        is_("range").alias("invalid_date_ranges"), is_("unordered").alias("unordered_rows"), F.count_if((F.col("reason") == "accepted") & F.col("invalid_education")).alias("invalid_education_rows"),
        is_("accepted").alias("accepted_rows"), F.countDistinct(F.when(F.col("reason") == "accepted", F.col("person"))).alias("accepted_people"),
    )
    pairs = dated_pairs(each.filter("reason = 'accepted'")).agg(
        F.count_if(F.col("reason") == "ambiguous").alias("ambiguous_same_start_pairs"), F.count_if("overlap").alias("overlapping_pairs"), F.count_if(F.col("reason") == "self").alias("self_transitions"),
        F.count_if(F.col("reason") == "valid").alias("valid_transitions"), F.countDistinct(F.when(F.col("reason") == "valid", F.struct("src", "dst"))).alias("distinct_transition_pairs"),
    )
    # three rows of one row each
    return raw.crossJoin(found).withColumn("exact_duplicate_rows", F.col("raw_rows") - F.col("distinct_rows")).drop("distinct_rows").crossJoin(pairs)


def _steps(value: Column, limits: tuple[int, ...], first: int) -> Column:
    """first for values up to the first limit, one more for each further limit that is passed."""
    out = F.lit(first)
    for x in limits:
        out = out + (value > x).cast("int")
    return out


def tenure_bucket(start: Column, end: Column) -> Column:
    """Quarters in a role, 1 ... 8; 0 for unknown."""
    return F.coalesce(_steps(end - start, (0, 1, 3, 7, 15, 31, 63), 1), F.lit(0))


def gap_bucket(previous_end: Column, start: Column) -> Column:
    """Quarters between two roles, 1 (overlap) ... 7; 0 for unknown."""
    return F.coalesce(_steps(start - previous_end, (-1, 0, 1, 3, 7, 15), 1), F.lit(0))


def education_bucket(level: Column, use: bool) -> Column:
    """1 ... 5 by education; 0 for unknown, or for all where it is not to be used."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, EDUCATION_ORDER)), level), F.lit(0)).cast("int") if use else F.lit(0)


def feature_prefixes(rows: DataFrame, longest: int = 20, education: bool = False) -> DataFrame:
    """(person, n, history, target, tenure, gap, education): a fold over a person's rows by (order, role).

    A row is retained unless it has the order or the role of the last retained one; each retained row but the
    first is a target. What is said about it comes from the rows retained before: the last one's tenure
    and education, and the gap between the two last."""
    kind = "array<struct<order:int,role:string,start:int,end:int,university_level:string>>"
    row = F.struct(F.col("order").cast("int").alias("order"), "role", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "university_level")
    ordered = rows.groupBy("person").agg(F.array_sort(F.collect_list(row)).cast(kind).alias("rows"))

    def step(acc: Column, r: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        same = (last["order"] == r["order"]) | (last["role"] == r["role"])
        return F.when(F.size(acc) == 0, F.array(r)).when(same, acc).otherwise(F.concat(acc, F.array(r))).cast(kind)

    kept = ordered.select("person", F.aggregate("rows", F.array().cast(kind), step).alias("kept"))
    each = kept.select("person", "kept", F.posexplode("kept").alias("i", "r")).filter("i > 0")
    last, before = F.get("kept", F.col("i") - 1), F.get("kept", F.col("i") - 2)
    history = F.transform(F.slice("kept", F.greatest(F.lit(1), F.col("i") - longest + 1), F.least(F.col("i"), F.lit(longest))), lambda x: x["role"])
    return each.select(
        "person", F.col("i").alias("n"), history.alias("history"), F.col("r.role").alias("target"),
        tenure_bucket(last["start"], last["end"]).alias("tenure"), F.when(F.col("i") > 1, gap_bucket(before["end"], last["start"])).otherwise(0).alias("gap"), education_bucket(last["university_level"], education).alias("education"),
    )


def person_runs(rows: DataFrame) -> DataFrame:
    """(person, runs, rows): stretches of neighbouring rows of one person in each file; more than one run means
    that the person comes back. rows: (file, row_pos, person).

    Files are read in parallel and each is walked in its own order."""
    w = Window.partitionBy("file").orderBy("row_pos")
    first = F.coalesce(F.lag("person").over(w) != F.col("person"), F.lit(True))
    return rows.withColumn("first", first).groupBy("person").agg(F.count_if("first").alias("runs"), F.count("*").alias("rows"))


def out_of_order(rows: DataFrame) -> DataFrame:
    """(person): people whose ord falls somewhere in row order. rows: (person, ord, row_pos)."""
    w = Window.partitionBy("person").orderBy("row_pos")
    return rows.withColumn("before", F.lag("ord").over(w)).filter("before > ord").select("person").distinct()


def split_overlap(steps: DataFrame) -> DataFrame:
    """(first, second, people): people that two splits share; empty where splits are disjoint."""
    by = steps.select("person", "split").distinct()
    other = by.select(F.col("person").alias("p"), F.col("split").alias("second"))
    return by.join(other, (F.col("person") == F.col("p")) & (F.col("split") < F.col("second"))).groupBy(F.col("split").alias("first"), "second").agg(F.count("*").alias("people"))
