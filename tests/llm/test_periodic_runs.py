"""Periodic runs against a search of all stretches."""

import hashlib
import random
import re
import zlib

import pytest

from waymark.llm import entries, periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w, min_words=6, exponent=4):
    n, out = len(w), set()
    for p in range(1, n // exponent + 1):
        i = p
        while i < n:
            m = i
            while m < n and w[m] == w[m - p]:
                m += 1
            if m - i + p >= max(min_words, exponent * p):
                s, length = i - p, m - i + p
                if not any(all(w[j] == w[j - q] for j in range(s + q, s + length)) for q in range(1, p)):
                    out.add((s, length, p))
            i = m + 1 if m == i else m
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(w, runs):
    return " ".join(x for i, x in enumerate(w) if not any(s + p <= i < s + n for s, n, p in runs))


def texts():
    r = random.Random(3)
    out = []
    for letters in (1, 2, 3, 5, 30):
        for _ in range(60):
            out.append([str(r.randrange(letters)) for _ in range(r.randint(0, 60))])
    for _ in range(150):  # periodic inside, in blocks that repeat blocks themselves
        block = [str(r.randrange(3)) for _ in range(r.randint(1, 7))] * r.randint(1, 5) + [str(r.randrange(3)) for _ in range(r.randint(0, 4))]
        head, tail = ([str(r.randrange(4)) for _ in range(r.randint(0, 9))] for _ in range(2))
        out.append(head + block * r.randint(1, 7) + block[: r.randint(0, len(block))] + tail)
    a, b = ["0"], ["1"]
    for _ in range(7):  # no run of this text has three periods; then it's repeated
        a, b = a + b, b + a
    fib, last = ["0", "1"], ["0"]
    for _ in range(9):
        fib, last = fib + last, fib
    return [*out, a, a * 4 + a[:7], fib, fib * 4]


def test_runs_equal_a_search_of_all_stretches():
    some = texts()
    assert sum(bool(plain_runs(w)) for w in some) > 150
    for w in some:
        assert periodic_runs.runs_of(w) == plain_runs(w), w
    for w in some[::3]:
        assert periodic_runs.runs_of(w, 3, 3) == plain_runs(w, 3, 3), w


def test_long_texts_take_time_of_their_length():
    assert periodic_runs.runs_of([b"a"] * 200_000) == [(0, 200_000, 1)]
    every_other = [x for i in range(100_000) for x in (b"a", b"%d" % i)]
    assert periodic_runs.runs_of(every_other) == []
    block = [b"%d" % i for i in range(20_000)]
    assert periodic_runs.runs_of([b"x", *block * 5, b"y"]) == [(1, 100_000, 20_000)]
    with pytest.raises(ValueError):
        periodic_runs.runs_of([b"a"] * 9, exponent=2)


def test_documents(spark):
    rows = [(1, "a b a b a b a b c", 9), (1, "a b a b a b a b c", 9), (None, "x\x0cx x\tx x x", 1), (2, None, 1), (3, "", 1), (4, " \n ", None), (5, "é\xa0é " * 6, 2), (6, "one", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = sorted(periodic_runs.periodic_runs(docs).collect(), key=str)
    assert len(got) == len(rows)
    at = {r.doc_id: r for r in got}
    assert [tuple(x) for x in at[1].runs] == [(0, 8, 2)] and at[1].collapsed == "a b c"
    assert [tuple(x) for x in at[None].runs] == [(0, 6, 1)] and at[None].collapsed == "x"
    assert [tuple(x) for x in at[5].runs] == [(0, 6, 1)] and at[5].collapsed == "é\xa0é"
    assert all((at[i].n_words, at[i].runs, at[i].collapsed) == (0, [], "") for i in (2, 3, 4))
    assert periodic_runs.periodic_runs(docs.limit(0)).collect() == []


def test_query_equals_the_contract(spark, tmp_path):
    r = random.Random(8)
    rows = [(i, " ".join(r.choices("ab cd e f".split(), k=r.randint(0, 90)))) for i in range(400)] + [(400, None), (401, ""), (402, "w"), (None, "a " * 7)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in entries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    planted = 0
    for d, t in rows:
        w = WORD.findall(t or "")
        n, h = len(w), zlib.crc32(str(d).encode())
        g = h // 10
        if d is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
            planted += 1
        runs = plain_runs(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        want = (len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4))
        x = got[d]
        assert (x.n_runs, x.start, x.length, x.period, x.exponent_milli) == want
        assert x.runs_sha256 == sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)) and x.collapsed_sha256 == sha(plain_collapsed(w, runs))
    assert planted > 20
