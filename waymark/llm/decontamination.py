"""Benchmark decontamination by templates, in DataFrame functions only.

Numbers, units and names become typed placeholders, so a question and the same question with other
parameters have one template. Windows of template words are hash-joined with those of the benchmark;
before that, a bitmap of the first words of the benchmark's windows leaves out most places of a text.
What stood in a window's slots must then map consistently: along one alignment of a document with
an item, slots of one value in the item should meet one value in the document, and slots of one
value in the document come from one of the item. A single repeated value says nothing, for two
amounts of an item may be equal by chance; of more, at least half must agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Units, which count as such behind a number.
UNITS = (
    "g kg mg lb lbs oz t ton tons l ml m km cm mm mi mile miles ft foot feet inch inches yard yards s sec second seconds min minute minutes h hr hour hours "
    "day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees mph kmh w kw v hz gb mb kb"
).split()
SIGNS = ("%", "$", "€", "£")
STOPS = (".", "?", "!", ":", "\n")
_TOKEN = r"[\p{L}\p{M}]+(?:['’]\p{L}+)?|\p{N}+(?:[.,]\p{N}+)*|[%$€£.?!:\n]"
NUMBER, UNIT, NAME = "<num>", "<unit>", "<name>"
#: Windows of the benchmark up to which they are broadcast (about 40 bytes each).
BROADCAST_WINDOWS = 500_000


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once. A plain column would be put into each lambda that
    names it, and worked out anew for every element."""
    return F.transform(F.array(value), body)[0]


def _starts_with_digit(t: Column) -> Column:
    return (t >= "0") & (t < ":")


def _canon(tokens: Column, t: Column, i: Column, put) -> Column:
    """put(what token t has in a template), null for a stop. The most frequent case comes first: these
    expressions run once for every word."""
    before, low = F.get(tokens, i - 1), F.lower(t)
    unit = low.isin(*UNITS) & _starts_with_digit(before)
    head = F.substring(t, 1, 1)
    return (
        F.when((t >= "a") & (t < "{"), F.when(unit, put(F.lit(UNIT))).otherwise(put(low)))
        .when(t.isin(*STOPS), None)
        .when(_starts_with_digit(t), put(F.lit(NUMBER)))
        .when(t.isin(*SIGNS) | unit, put(F.lit(UNIT)))
        .when((i > 0) & ~before.isin(*STOPS) & (head != F.lower(head)), put(F.lit(NAME)))
        .otherwise(put(low))
    )


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), F.lit(0))


def template(text: Column) -> Column:
    """Array of (raw, canon): the words of a text and what they are in its template. Null has none.

    A number is digits, with points or commas inside; a unit is a sign of money or percent, or a
    unit's word behind a number; a name is a word with a capital that doesn't begin a sentence."""
    words = lambda tokens: F.transform(tokens, lambda t, i: F.struct(F.lower(t).alias("raw"), _canon(tokens, t, i, lambda c: c).alias("canon")))
    return F.filter(_let(_tokens(text), words), lambda x: x["canon"].isNotNull())


def _with_template(df: DataFrame, text_col: str) -> DataFrame:
    """df with w: the template as arrays raw (words as they stand) and h (hashes of what they are).
    The generator keeps the optimizer from working the template out once for each use."""
    hashes = lambda tokens: F.filter(F.transform(tokens, lambda t, i: _canon(tokens, t, i, F.xxhash64)), lambda h: h.isNotNull())
    both = lambda tokens: F.struct(F.filter(tokens, lambda t: ~t.isin(*STOPS)).alias("raw"), hashes(tokens).alias("h"))
    return df.withColumn("w", F.explode(F.array(_let(_tokens(F.col(text_col)), both))))


def _raw(first: Column, size: Column) -> Column:
    return F.transform(F.slice("w.raw", first + 1, size), F.lower)


def _hash(first: Column, size: Column, exact: Column) -> Column:
    """Of a window's template, or of its words themselves."""
    return F.when(exact, F.xxhash64(_raw(first, size))).otherwise(F.xxhash64(F.slice("w.h", first + 1, size)))


def _lead(h: Column, i: Column, n: int) -> Column:
    """A key of the n words (three at most) from place i on."""
    key = F.get(h, i)
    for k in range(1, n):
        key = key.bitwiseXOR(F.shiftleft(F.get(h, i + k), 7 * k))
    return key


#: Bits of the bitmap: sixteen or more for each window of the benchmark, within these powers of two. Beyond that more
#: places reach the join than need to; the result is the same.
LEAST_BITS, MOST_BITS = 16, 22


def _bit(key: Column, power: int) -> tuple[Column, Column]:
    """(number of the 64-bit word, bit in it) of a key in a bitmap of 2**power bits."""
    return F.shiftrightunsigned(key, 64 - power + 6).cast("int"), F.shiftrightunsigned(key, 64 - power).bitwiseAND(F.lit(63)).cast("int")


def _bitmap(items: DataFrame, lead: int, power: int) -> Column:
    """The leads of all windows of the benchmark as an array of 64-bit words: a constant of bounded size."""
    word, bit = _bit(F.col("lead"), power)
    rows = items.select("lead").distinct().select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).collect()
    bits = [0] * (1 << (power - 6))
    for r in rows:
        bits[r["word"]] = r["bits"]
    return F.from_json(F.lit("[" + ",".join(map(str, bits)) + "]"), "array<bigint>")


def _item_windows(benchmark: DataFrame, window: int, least_words: int, lead: int) -> DataFrame:
    """(item_id, n_windows, n_words, ipos, size, exact, hash, lead, item_raw, slots): the windows of every item that hold
    `least_words` plain words, or as many as the item has if it is shorter. An item shorter than a window is one.
    Other windows say too little by their template; of an item that has no better ones, as of names and numbers
    alone, they are exact: found by their words as they are."""
    words = _with_template(benchmark.select("item_id", "text"), "text").filter(F.size("w.h") > 0)
    sized = words.select("item_id", "w", F.size("w.h").alias("n_words"), F.least(F.lit(window), F.size("w.h")).alias("size"))
    w = sized.withColumn("ipos", F.explode(F.sequence(F.lit(0), F.col("n_words") - F.col("size"))))
    fixed = [F.xxhash64(F.lit(x)) for x in (NUMBER, UNIT, NAME)]
    w = w.withColumn("slots", F.transform(F.slice("w.h", F.col("ipos") + 1, F.col("size")), lambda h: h.isin(*fixed)))
    w = w.withColumn("exact", F.size(F.filter("slots", lambda s: ~s)) < F.least(F.lit(least_words), F.col("size")))
    good = w.filter(~F.col("exact")).groupBy("item_id").agg(F.countDistinct("ipos").alias("n_good"))
    w = w.join(good, "item_id", "left").filter(~F.col("exact") | F.col("n_good").isNull())
    n = F.coalesce("n_good", (F.col("n_words") - F.col("size") + 1).cast("long"))
    w = w.select(
        "item_id", n.alias("n_windows"), "n_words", "ipos", "size", "exact", _hash(F.col("ipos"), F.col("size"), F.col("exact")).alias("hash"),
        _lead(F.col("w.h"), F.col("ipos"), lead).alias("lead"), _raw(F.col("ipos"), F.col("size")).alias("item_raw"), "slots",
    )
    return w.dropDuplicates(["item_id", "ipos", "hash"])


def _agreeing(pairs: Column) -> Column:
    """Of pairs (k, v): how many lie beyond the first of their k, and how many of those have the k's most frequent v."""
    # in order of k, then v: the sum of each k's longest run of one v
    zero = F.struct(F.lit(None).cast("string").alias("k"), F.lit(None).cast("string").alias("v"), F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(0).alias("sum"))

    def step(a: Column, x: Column) -> Column:
        same = a["k"].eqNullSafe(x["k"])
        run = F.when(same & (a["v"] == x["v"]), a["run"] + 1).otherwise(1)
        best = F.when(same, F.greatest(a["best"], run)).otherwise(1)
        more = F.when(same, F.greatest(run - a["best"], F.lit(0))).otherwise(1)
        return F.struct(x["k"].alias("k"), x["v"].alias("v"), run.alias("run"), best.alias("best"), (a["sum"] + more).alias("sum"))

    keys = F.size(F.array_distinct(F.transform(pairs, lambda x: x["k"])))
    kept = F.aggregate(F.array_sort(pairs), zero, step, lambda a: a["sum"])
    return F.struct((F.size(pairs) - keys).alias("repeats"), (kept - keys).alias("agree"))


def _consistency(slots: Column) -> Column:
    """Share of an alignment's repeated values that agree, in both directions, of slots (pos, k, v); 1 with one repeat or none."""
    one = F.transform(slots, lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v")))
    two = F.transform(slots, lambda x: F.struct(x["v"].alias("k"), x["k"].alias("v")))
    both = F.struct(_agreeing(one).alias("a"), _agreeing(two).alias("z"))

    def share(x: Column) -> Column:
        # one repeat on a side, with none or one on the other, is one coincidence
        repeats = x["a"]["repeats"] + x["z"]["repeats"]
        few = F.greatest(x["a"]["repeats"], x["z"]["repeats"]) <= 1
        return F.when(few, 1.0).otherwise((x["a"]["agree"] + x["z"]["agree"]) / repeats)

    return _let(both, share)


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 8, least_words: int = 4, coverage: float = 0.4, words: float = 0.6, consistent: float = 0.5) -> DataFrame:
    """(doc_id, text_hash, item_id, n_windows, n_matched, n_exact, coverage, word_coverage, consistency): documents that hold an item.

    docs: (doc_id, text), benchmark: (item_id, text). Only alignments count of whose repeated slot values a
    share of `consistent` or more agrees; consistency is the least share of those that count. A row a
    document and item of which at least `coverage` of the windows occur there, or whose windows there
    cover two windows' length and `words` of the item's words, as in a copy with edits all over; n_exact
    counts the windows with the item's own values. Windows of names and numbers alone count only where
    their own values stand. Null and empty texts hold nothing, null item ids are skipped, rows of `docs`
    with equal id and text are one; very long texts are read whole. No Python runs here.

    A text's places are tested where it is read, windows are hashed at those that pass; the benchmark's
    windows are counted and broadcast up to BROADCAST_WINDOWS, so only matches are shuffled. Beyond
    that the windows are shuffled by hash."""
    known = benchmark.filter("item_id is not null")
    lead = 3
    shapes = _item_windows(known, window, least_words, lead).groupBy("size", "exact").count().collect()
    lead = min([lead, *(r["size"] for r in shapes)])
    items = _item_windows(known, window, least_words, lead)
    total = sum(r["count"] for r in shapes)
    power = min(MOST_BITS, max(LEAST_BITS, (16 * total).bit_length()))
    small = total <= BROADCAST_WINDOWS
    base = _with_template(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), "text").select("doc_id", "text_hash", "w")
    bits = _bitmap(items, lead, power)

    def passing(key: Column, i: Column) -> Column:
        word, bit = _bit(key, power)
        return F.when(F.bit_get(F.get(bits, word), bit) == 1, i)

    leads = _let(F.col("w.h"), lambda h: F.transform(h, lambda x, i: _lead(h, i, lead)))
    places = F.array_compact(F.transform(leads, passing))
    kinds = F.array(*(F.struct(F.lit(r["size"]).alias("size"), F.lit(r["exact"]).alias("exact")) for r in shapes)) if shapes else F.lit(None).cast("array<struct<size:int,exact:boolean>>")
    here = base.select("doc_id", "text_hash", "w", F.explode(places).alias("pos")).select("doc_id", "text_hash", "w", "pos", F.explode(kinds).alias("kind"))
    here = here.filter(F.col("pos") + F.col("kind.size") <= F.size("w.h")).select("doc_id", "text_hash", "w", "pos", "kind.size", "kind.exact", _hash(F.col("pos"), F.col("kind.size"), F.col("kind.exact")).alias("hash"))
    hits = here.join(F.broadcast(items) if small else items, ["hash", "size", "exact"]).select(
        "doc_id", "text_hash", "item_id", "n_windows", "n_words", "size", "ipos", (F.col("pos") - F.col("ipos")).alias("shift"), _raw(F.col("pos"), F.col("size")).alias("raw"), "item_raw", "slots"
    )
    slot = lambda x, i: F.when(x["slots"], F.struct((F.col("ipos") + i).alias("pos"), x["item_raw"].alias("k"), x["raw"].alias("v")))
    slots = F.filter(F.transform(F.arrays_zip("slots", "item_raw", "raw"), slot), lambda x: x.isNotNull())
    aligned = hits.groupBy("doc_id", "text_hash", "item_id", "shift").agg(
        F.max("n_windows").alias("n_windows"), F.max("n_words").alias("n_words"), F.max("size").alias("size"),
        F.collect_set("ipos").alias("at"),
        F.array_distinct(F.flatten(F.collect_set(slots))).alias("map"),
        F.count_if(F.col("raw") == F.col("item_raw")).alias("n_exact"),
    )
    cover = F.array_distinct(F.flatten(F.transform("at", lambda i: F.sequence(i, i + F.col("size") - 1))))
    return (
        aligned.withColumn("consistency", _consistency(F.col("map")))
        .filter(F.col("consistency") >= consistent)
        .withColumn("cover", cover)
        .groupBy("doc_id", "text_hash", "item_id")
        .agg(
            F.max("n_windows").alias("n_windows"), F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("n_matched"), F.sum("n_exact").alias("n_exact"),
            F.max("n_words").alias("n_words"), F.max("size").alias("size"), F.size(F.array_distinct(F.flatten(F.collect_list("cover")))).alias("n_covered"), F.min("consistency").alias("consistency"),
        )
        .withColumn("coverage", F.col("n_matched") / F.col("n_windows"))
        .withColumn("word_coverage", F.col("n_covered") / F.col("n_words"))
        .filter((F.col("coverage") >= coverage) | ((F.col("word_coverage") >= words) & (F.col("n_covered") >= 2 * F.col("size"))))
        .select("doc_id", "text_hash", "item_id", "n_windows", "n_matched", "n_exact", "coverage", "word_coverage", "consistency")
    )


def clean(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of `docs` that hold no item, with all their columns.

    A verdict depends on the text alone and is joined by text and id, so repeated ids with other
    texts and null ids are judged by their own texts."""
    found = contaminated(docs, benchmark, **settings).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]) & F.xxhash64(docs["text"]).eqNullSafe(found["_hash"]), "left_anti")
