"""The packed model against a plain one with dictionaries."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import katz


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), "</s>"]


class Plain:
    def __init__(self, texts, head):
        self.uni, self.pair, self.behind = Counter(), Counter(), {}
        for t in texts:
            before = "<s>"
            for w in tokens(t):
                self.uni[w] += 1
                self.pair[before, w] += 1
                self.behind.setdefault(before, set()).add(w)
                before = w
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        of = lambda counts: np.array([sum(c == r for c in counts.values()) for r in range(katz.DISCOUNTED + 2)], float)
        self.d1, self.d2 = katz.discounts(of(self.uni)), katz.discounts(of(self.pair))
        least = min((c for c in {*self.uni.values()} if sum(x >= c for x in self.uni.values()) <= head), default=math.inf)
        self.head = {w: self.cut(self.d1, c) * c / (self.n + 0.5) for w, c in self.uni.items() if c >= least}
        self.rest = (1 - sum(self.head.values())) / (self.v - len(self.head) + 1)

    @staticmethod
    def cut(d, r):
        return d[r] if r <= katz.DISCOUNTED else 1.0

    def p1(self, w):
        return self.head.get(w, self.rest)

    def p(self, h, w):
        total = sum(self.pair[h, x] for x in self.behind.get(h, ()))
        if not total:
            return self.p1(w)
        seen = {x: self.cut(self.d2, self.pair[h, x]) * self.pair[h, x] / (total + 0.5) for x in self.behind[h]}
        if w in seen:
            return seen[w]
        return (1 - sum(seen.values())) / (1 - sum(self.p1(x) for x in seen)) * self.p1(w)

    def score(self, text):
        before, total = "<s>", 0.0
        for w in tokens(text):
            total += math.log10(self.p(before, w))
            before = w
        return total


def held(i):
    return zlib.crc32(("null" if i is None else str(i)).encode()) % 10 == 0


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(7)
    words = [f"w{i}" for i in range(60)] + ["the", "The", "of", "é"]
    weight = [1 / (i + 1) for i in range(60)] + [3, 1, 2, 0.3]
    rows = [(i, " ".join(r.choices(words, weight, k=r.randint(0, 60)))) for i in range(300)]
    return [*rows, (None, "the of the"), (400, None), (401, ""), (402, " \n\t "), (3, rows[3][1]), (403, "new\x0bwords here " * 50), (404, "a\x0cb")]


@pytest.mark.parametrize(("head", "hot"), [(10**6, katz.HOT), (12, katz.HOT), (12, 0), (0, 3)])
def test_scores_equal_a_plain_model(spark, corpus, head, hot, monkeypatch):
    monkeypatch.setattr(katz, "HOT", hot)
    docs = spark.createDataFrame([(i, t, "x") for i, t in corpus], "doc_id long, text string, score string").repartition(5)
    found = katz.scores(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) % 10 == 0, head).collect()
    plain = Plain([t for i, t in corpus if not held(i)], head)
    want = []
    for i, t in corpus:
        ts = tokens(t)
        base = sum(math.log10((plain.uni[w] + 0.1) / (plain.n + 0.1 * (plain.v + 1))) for w in ts)
        want.append((i, held(i), len(ts), sum(plain.uni[w] > 0 for w in ts), plain.n, base, plain.score(t)))
    key = lambda x: (x[0] is not None, x[0] or 0, x[6])
    assert len(found) == len(want)
    for a, b in zip(sorted(map(tuple, found), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9)
        assert a[6] == pytest.approx(b[6], rel=1e-9)


@pytest.mark.parametrize(("cached", "hot"), [(10**6, katz.HOT), (12, katz.HOT), (12, 0), (0, 3)])
def test_every_training_word_has_its_own_probability(spark, corpus, cached, hot, monkeypatch):
    monkeypatch.setattr(katz, "HOT", hot)
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
    found = katz.scores(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) % 10 == 0, cached=cached).collect()
    plain = Plain([t for i, t in corpus if not held(i)], math.inf)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert len(found) == len(corpus)
    for a, b in zip(sorted(((r.doc_id, r.score) for r in found), key=key), sorted(((i, plain.score(t)) for i, t in corpus), key=key), strict=True):
        assert a[0] == b[0]
        assert a[1] == pytest.approx(b[1], rel=1e-9)


def test_probabilities_sum_to_one(corpus):
    plain = Plain([t for i, t in corpus if not held(i)], 12)
    for h in ["<s>", "the", "w0", "w59", "never seen"]:
        every = sum(plain.p(h, w) for w in plain.uni) + plain.p(h, "unknown")
        assert every == pytest.approx(1, rel=1e-9)


def test_empty_table_and_no_training_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert katz.scores(none, F.lit(False)).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = katz.scores(one, F.lit(True)).collect()[0]
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (True, 3, 0, 0)


def test_discounts_by_hand():
    """Counts of counts 8, 3, 2, 1, 1, 1: d(r) = ((r + 1) n(r + 1) / (r n(r)) - k) / (1 - k) with k = 6 n(6) / n(1)."""
    n = np.array([0, 100, 40, 20, 12, 8, 5], float)
    d = katz.discounts(n)
    k = 6 * n[6] / n[1]
    for r in range(1, 6):
        assert d[r] == pytest.approx(((r + 1) * n[r + 1] / (r * n[r]) - k) / (1 - k))


def test_places_are_ordered_alike_when_one_number_is_too_small():
    rng = np.random.default_rng(1)
    bucket, context, word = (rng.integers(0, 50, 500) for _ in range(3))
    assert (katz._order(20, 50, bucket, context, word) == katz._order(40, 50, bucket, context, word)).all()
