"""Phrases by a trie, and what texts say of them, against searches of all pairs."""

import random
import re

from waymark.operators import graph as g
from waymark.operators import phrases as ph
from waymark.operators import text as x


def test_walk_finds_phrases_of_any_length(spark):
    r = random.Random(4)
    known = {" ".join(r.choices("abc", k=r.randint(1, 6))) for _ in range(60)} | {" ".join(f"w{i}" for i in range(n)) for n in range(1, 16)}
    texts = [(i, " ".join(r.choices("abcd", k=r.randint(0, 40)))) for i in range(60)] + [(60, " ".join(f"w{i}" for i in range(20))), (61, ""), (62, "w0 w1 w0 w1 w2")]
    want = set()
    for i, t in texts:
        w = t.split()
        for at in range(len(w)):
            for n in range(1, 16):
                p = " ".join(w[at : at + n])
                if at + n <= len(w) and p in known:
                    want.add((i, at, p))
    t, p = spark.createDataFrame(texts, "id long, key string"), spark.createDataFrame([(k,) for k in known], "phrase string")
    got = [tuple(row) for row in ph.walk(t, p, ["id"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len({n for _, _, n in want}) > 40
    assert ph.walk(t, p.limit(0), ["id"]).collect() == [] and ph.walk(t.limit(0), p, ["id"]).collect() == []
    # a step doesn't make rows of all runs: only places where a phrase begins are on the way
    first = {k.split()[0] for k in known}
    assert ph.trie(p).filter("node = ''").count() == len(first)


def plain_owned(phrase, key):
    """By letters, one mention after the other."""
    spots = lambda of: [(m.start(), m.end()) for p in of for m in re.finditer(rf"(?<!\S){re.escape(p)}(?!\S)", key)]
    denials = spots(ph.DENIALS)
    marks = [(b, False) for a, b in spots(ph.CLAIMS) if not any(c >= a - ph.REACH and e <= a for c, e in denials)]
    marks += [(b, True) for _, b in denials + spots(ph.WISHES)]
    verdicts = []
    for m in re.finditer(rf"(?<!\S){re.escape(phrase)}(?!\S)", key):
        before = [x for x in marks if x[0] <= m.start()]
        verdicts.append(not max(before)[1] if before else len(key.split()) <= ph.TERSE)
    return any(verdicts) if verdicts else None


def test_ownership_equals_a_search_by_letters(spark):
    r = random.Random(12)
    words = [*ph.CLAIMS, *ph.DENIALS[:8], *ph.WISHES[:6], "but", "and", "the", "go", "r", "machine learning", "use of safety procedures in the kitchen"]
    texts = [(i, " ".join(r.choices(words, k=r.randint(1, 9)))) for i in range(400)]
    phrases = ["r", "go", "machine learning", "use of safety procedures in the kitchen"]
    df = spark.createDataFrame(texts, "id long, text string")
    got = {(row.id, row.phrase): row.owned for row in ph.owned_phrases(df, spark.createDataFrame([(p,) for p in phrases], "phrase string"), ["id"]).collect()}
    want = {(i, p): plain_owned(p, t) for i, t in texts for p in phrases}
    assert got == {k: v for k, v in want.items() if v is not None}
    assert 50 < sum(got.values()) < len(got) - 50


def test_long_aliases_and_verdicts(spark):
    aliases = spark.createDataFrame([("use of safety procedures in the kitchen", "s1"), ("cooking", "s2"), ("go", "s3")], "alias string, id string")
    texts = spark.createDataFrame([(1, "I know use of safety procedures in the kitchen. I want to learn cooking!"), (2, "Go; I do not know cooking"), (3, None), (1, "I know use of safety procedures in the kitchen. I want to learn cooking!")], "query_id long, text string")
    assert sorted(map(tuple, x.owned_mentions(texts, aliases).collect())) == [(1, "use of safety procedures in the kitchen", True), (2, "cooking", False)]
    asked = spark.createDataFrame([(1, "Advanced cooking"), (1, "use of safety procedures in the kitchen"), (2, "GO"), (2, "sewing"), (4, "cooking")], "query_id long, phrase string")
    got = {(r.query_id, r.phrase): r.verdict for r in x.judged_phrases(asked, aliases, texts).collect()}
    assert got == {(1, "Advanced cooking"): "excluded", (1, "use of safety procedures in the kitchen"): "matched", (2, "GO"): "matched", (2, "sewing"): "unmatched", (4, "cooking"): "matched"}


def test_entities_by_rule(spark):
    cases = {
        "Rust is nice. Then Data Engineer, and (Go) too": ["Data Engineer", "Then Data Engineer"][1:],
        "You use CI/CD and Java/Kotlin": ["You", "CI/CD", "Java", "Kotlin"][1:],
        "ask about knowledge of deep welding and more": ["deep welding"],
        'the "your big plan" and **my Other Thing**!': ["Other Thing", "big plan"],
        "": [],
        "we met Anna and Anna": ["Anna"],
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "query_id long, text string")
    got = {}
    for r in x.extract_entities(rows).orderBy("query_id", "n").collect():
        got.setdefault(r.query_id, []).append(r.entity)
    assert [got.get(i, []) for i in range(len(cases))] == list(cases.values())


def test_reach_from_both_ends_equals_reach_from_one(spark):
    r = random.Random(6)
    nodes = [f"n{i}" for i in range(60)]
    edges = spark.createDataFrame([(r.choice(nodes), r.choice(nodes)) for _ in range(75)], "src string, dst string")
    starts = spark.createDataFrame([(q, r.choice(nodes)) for q in range(25) for _ in range(2)], "query_id long, id string")
    ends = spark.createDataFrame([(q, x) for q in range(26) for x in r.sample(nodes, 12)], "query_id long, id string")
    asked = {(e.query_id, e.id) for e in ends.collect()}
    sizes = []
    for hops in range(5):
        far = {(e.query_id, e.id) for e in g.reach(edges, starts, hops).collect()} & asked
        got = [(e.query_id, e.id) for e in g.reached(edges, starts, ends, hops).collect()]
        assert len(got) == len(set(got)) and set(got) == far
        sizes.append(len(far))
    assert sizes == sorted(sizes) and sizes[0] < sizes[2] < sizes[4] < len(asked)
