"""Histories: small tables whose counts are worked out by hand."""

import pytest
from pyspark.sql import functions as F

from waymark.operators import trajectories as t

#: One person for each thing that can happen; kim repeats a row, ida says two things at once, ole skips a quarter.
STEPS = [
    ("ann", 3, "cook"), ("ann", 4, "baker"), ("ann", 5, "baker"), ("ann", 6, "cook"),
    ("kim", 7, "cook"), ("kim", 8, "baker"), ("kim", 8, "baker"), ("kim", 8, "baker"),
    ("ida", 1, "smith"), ("ida", 2, "cook"), ("ida", 2, "smith"), ("ida", 3, "baker"), ("ida", 4, "smith"),
    ("ole", 0, "cook"), ("ole", 2, "baker"), ("ole", 3, None), ("ole", 4, "smith"), ("ole", 5, "clown"),
]


@pytest.fixture(scope="module")
def steps(spark):
    return spark.createDataFrame(STEPS, "person string, ord long, label string").withColumn("split", F.lit("train"))


def test_quality_counts_every_reason(spark, steps):
    more = steps.unionByName(spark.createDataFrame([("una", None, "cook", "train")], "person string, ord long, label string, split string"))
    index = spark.createDataFrame([("cook",), ("baker",), ("smith",)], "label string")
    row = t.quality(more, index).first().asDict()
    assert row == {
        "split": "train", "rows": 19, "people": 5, "invalid_orders": 1, "missing_labels": 1, "labels": 4, "unmapped_labels": 1, "unmapped": "clown",
        "positions": 15, "kept_positions": 13, "empty_positions": 1, "exact_duplicates": 2, "ambiguous_positions": 1,
        "pairs": 9, "gaps": 3, "self_transitions": 1, "unmapped_transitions": 1, "valid_transitions": 4, "distinct_transitions": 3,
    }


def test_counts_keep_the_unfiltered_total(steps):
    counted = t.transition_counts(t.transitions(steps))
    got = {(r.src, r.dst): (r["count"], r.source_total, r.probability) for r in counted.collect()}
    assert got == {("cook", "baker"): (2, 2, 1.0), ("baker", "cook"): (1, 2, 0.5), ("baker", "smith"): (1, 2, 0.5), ("smith", "clown"): (1, 1, 1.0)}
    assert [(r.src, r.dst, r.source_total) for r in t.transition_counts(t.transitions(steps), 2).collect()] == [("cook", "baker", 2)]


def test_unmapped_comes_behind_gap_and_self(steps):
    known = F.col("src").isin("cook", "baker") & F.col("dst").isin("cook", "baker")
    got = t.classified_pairs(t.kept_positions(steps), known).groupBy("reason").count().collect()
    assert {r.reason: r["count"] for r in got} == {"gap": 3, "self": 1, "unmapped": 2, "valid": 3}


def test_prefixes_restart_at_gaps(spark):
    rows = [(7, 5, "x"), (7, 6, "x"), (7, 7, "y"), (7, 8, "z"), (8, 1, "x"), (8, 3, "y"), (8, 4, "z"), (9, 2, "y")]
    got = t.prefixes(spark.createDataFrame(rows, "person long, ord long, label string")).collect()
    assert sorted((r.person, r.ord, tuple(r.history), r.target) for r in got) == [(7, 7, ("x",), "y"), (7, 8, ("x", "y"), "z"), (8, 4, ("y",), "z")]


def test_quarters(spark):
    rows = [("Q2 1999", 7997), ("Q3  2010", 8042), ("", None), (None, None), ("Q5 2001", None), ("2001 Q1", None), ("Q1 01", None)]
    got = spark.createDataFrame(rows, "q string, n int").select(t.parse_quarter(F.col("q")).alias("got"), "n").collect()
    assert all(r.got == r.n for r in got)


def test_buckets_at_every_limit(spark):
    days = [(None, 0, 0), (-5, 1, 1), (-1, 1, 1), (0, 1, 2), (1, 2, 3), (2, 3, 4), (3, 3, 4), (4, 4, 5), (7, 4, 5), (8, 5, 6), (15, 5, 6), (16, 6, 7), (31, 6, 7), (32, 7, 7), (63, 7, 7), (64, 8, 7)]
    rows = spark.createDataFrame([(8000, None if n is None else 8000 + n, a, b) for n, a, b in days], "a int, z int, tenure int, gap int")
    got = rows.select(t.tenure_bucket(F.col("a"), F.col("z")).alias("x"), t.gap_bucket(F.col("a"), F.col("z")).alias("y"), "tenure", "gap").collect()
    assert all((r.x, r.y) == (r.tenure, r.gap) for r in got)
    levels = spark.createDataFrame([("None", 1), ("PhD", 5), ("Diploma", 0), (None, 0)], "level string, n int")
    assert all(r.x == r.n and r.off == 0 for r in levels.select(t.education_bucket(F.col("level"), True).alias("x"), t.education_bucket(F.col("level"), False).alias("off"), "n").collect())


DATED = "person long, role string, order int, start int, end int, university_level string"


def test_fold_compares_with_the_last_retained_row_and_looks_back(spark):
    rows = [
        (5, "pilot", 40, 40, 47, "Master"), (5, "guide", 40, 40, 41, "Master"),  # the guide comes first by name, the pilot shares its quarter
        (5, "guide", 44, 44, 45, "Master"),  # again the last role that was kept
        (5, "judge", 50, None, 50, "Master"), (5, "nurse", 53, 53, None, "Master"), (5, "guide", 60, 60, 61, "Master"),
    ]
    got = t.feature_prefixes(spark.createDataFrame(rows, DATED), 2, True).orderBy("n").collect()
    assert [(tuple(r.history), r.target, r.tenure, r.gap, r.education) for r in got] == [
        (("guide",), "judge", 2, 0, 4),
        (("guide", "judge"), "nurse", 0, 0, 4),
        (("judge", "nurse"), "guide", 0, 4, 4),
    ]
    plain = t.feature_prefixes(spark.createDataFrame(rows, DATED), 9).orderBy("n").collect()
    assert [r.education for r in plain] == [0, 0, 0] and tuple(plain[2].history) == ("guide", "judge", "nurse")


RAW = [
    (1, "k1", "Q1 2003", "Q4 2003", "Bachelor"), (1, "k1", "Q1 2003", "Q4 2003", "Bachelor"), (1, "k2", "Q3 2003", None, "Secondary school"), (1, "k3", "Q3 2003", "Q1 2004", "Licence"),
    (1, " Unknown ", "Q1 2004", None, "PhD"), (1, "k9", "Q1 2004", None, "PhD"), (1, "k1", "Q2 2005", "Q1 2005", "PhD"), (1, "k2", None, "Q1 2006", "None"), (1, "k2", "Q1 2007", "", "None"),
    (2, "k1", "soon", "", "None"), (2, "", "Q1 2004", None, "PhD"), (2, "k1", "Q1 2004", "later", "Master"), (2, "k1", "Q2 2004", None, "Master"),
]


def test_dated_cleaning_counts_every_step(spark):
    raw = spark.createDataFrame(RAW, "resume_id long, matched_code string, start_date string, end_date string, university_level string")
    index = spark.createDataFrame([("k1", "one"), ("k2", "two"), ("k3", "three")], "code string, role string")
    row = t.dated_quality(raw, index).first().asDict()
    assert row == {
        "raw_rows": 13, "raw_people": 2, "exact_duplicate_rows": 1, "unknown_code_rows": 2, "unmapped_code_rows": 1, "unmapped_codes": "k9",
        "missing_start_dates": 1, "missing_end_dates": 4, "invalid_start_dates": 1, "invalid_end_dates": 1, "invalid_date_ranges": 1, "unordered_rows": 1, "invalid_education_rows": 1,
        "accepted_rows": 7, "accepted_people": 2, "ambiguous_same_start_pairs": 1, "overlapping_pairs": 1, "self_transitions": 3, "valid_transitions": 1, "distinct_transition_pairs": 1,
    }
    pairs = t.dated_pairs(t.dated_rows(raw, index)).collect()
    assert sorted((r.person, r.src, r.dst, r.reason, r.overlap) for r in pairs) == [
        (1, "one", "three", "valid", True), (1, "three", "two", "ambiguous", False), (1, "two", "two", "self", False), (1, "two", "two", "self", False), (2, "one", "one", "self", False),
    ]
    assert {r.university_level for r in t.dated_rows(raw, index).collect()} == {"Bachelor", "Secondary", "None", "Master"}


def test_folds_and_leave_one_out(steps):
    got = t.fold_counts(t.transitions(steps), 3).groupBy("src", "dst").agg(F.sum("count").alias("n"), F.max(F.col("count") + F.col("train_count")).alias("all")).collect()
    assert {(r.src, r.dst): (r.n, r["all"]) for r in got} == {("cook", "baker"): (2, 2), ("baker", "cook"): (1, 1), ("baker", "smith"): (1, 1), ("smith", "clown"): (1, 1)}


def test_splits_that_share_people(spark):
    rows = [("u", "validation"), ("u", "test"), ("v", "train"), ("w", "train"), ("w", "validation"), ("w", "train")]
    got = t.split_overlap(spark.createDataFrame(rows, "person string, split string")).collect()
    assert sorted(map(tuple, got)) == [("test", "validation", 1), ("train", "validation", 1)]


def test_runs_of_people_in_files(spark):
    rows = [("f", i, p) for i, p in enumerate("aabba")] + [("g", i, p) for i, p in enumerate("bb")]
    got = t.person_runs(spark.createDataFrame(rows, "file string, row_pos int, person string")).collect()
    assert {r.person: (r.runs, r.rows) for r in got} == {"a": (2, 3), "b": (2, 4)}


def test_empty_steps(spark):
    none = spark.createDataFrame([], "person string, ord long, label string")
    assert t.transition_counts(t.transitions(none)).collect() == []
    assert t.prefixes(t.kept_positions(none)).collect() == []
    assert t.feature_prefixes(spark.createDataFrame([], DATED)).collect() == []
