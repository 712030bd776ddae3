"""The quality verdict against a plain one; empty tables, ties, nulls and large payloads of the other operators."""

import random
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

from waymark.llm import pieces, quality, url_rules, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_verdict(text, limits):
    w = WORD.findall(text)
    chars = max(1, sum(map(len, w)))
    grams = lambda n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    three = Counter(grams(3))
    hit = {j + k for j, g in enumerate(grams(3)) if three[g] > 1 for k in range(3)}
    if len(w) < limits.min_words or 100 * len(hit) > limits.repeat_words_percent * len(w):
        return False
    lines = [x for x in text.split("\n") if WORD.search(x)]
    later = [x for i, x in enumerate(lines) if x in lines[:i]]
    if sum(map(len, later)) > limits.line_chars * max(1, sum(map(len, lines))) or len(later) > limits.lines * max(1, len(lines)):
        return False
    for n, most in limits.top.items():
        c = Counter(grams(n))
        if c and (k := max(c.values())) > 1 and min(chars, max(k * sum(map(len, g)) for g, m in c.items() if m == k)) / chars > most:
            return False
    for n, most in limits.repeated.items():
        seen, inside = set(), set()
        for j, g in enumerate(grams(n)):
            if g in seen:
                inside |= set(range(j, j + n))
            seen.add(g)
        if sum(len(w[j]) for j in inside) / chars > most:
            return False
    return True


def test_the_verdict_equals_a_plain_one():
    r = random.Random(6)
    v = ["".join(r.choices("abcdef", k=r.randint(1, 8))) for _ in range(250)]
    texts = []
    for _ in range(150):
        w = r.choices(v, k=r.randint(30, 160))
        for _ in range(r.randint(0, 4)):
            at, n = r.randrange(len(w)), r.randint(2, 16)
            w += w[at : at + n] * r.randint(1, 2)
        lines = [" ".join(w[i : i + 12]) for i in range(0, len(w), 12)]
        texts.append("\n".join(lines + r.choices(lines, k=r.choice([0, 0, 1, 3]))))
    limits = quality.Limits()
    got = quality.measure(texts, limits)["kept"]
    want = [plain_verdict(t, limits) for t in texts]
    assert got == want and 20 < sum(want) < 130


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality.repetition(docs).collect() == [] and quality.kept(docs).collect() == []
    pages = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string")
    assert url_rules.judge(pages, rules).collect() == []
    some = spark.createDataFrame([(1, "http://a.com/x"), (2, None)], "page_id long, url string")
    assert {(x.page_id, x.rule, x.verdict) for x in url_rules.judge(some, rules.limit(0), "maybe").collect()} == {(1, None, "maybe"), (2, None, "maybe")}


def test_rules_of_one_length_stay_apart(spark):
    rules = spark.createDataFrame([("ab.com", "/x", "block"), ("b.com", "/xyz", "allow"), ("ab.com", "/x", "block")], "host string, path string, verdict string")
    got = url_rules.judge(spark.createDataFrame([(1, "http://ab.com/xyz"), (2, "http://b.com/xyz"), (3, "http://c.ab.com/x")], "page_id long, url string"), rules).collect()
    assert {(x.page_id, x.rule, x.verdict) for x in got} == {(1, "ab.com/x", "block"), (2, "b.com/xyz", "allow"), (3, "ab.com/x", "block")}


def test_null_ids_and_lists_of_pieces(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = [None, "", "plain words twice plain words", "two  spaces", " first", "tab\tand\nline", "\x00zero", "é" * 300]
    docs = spark.createDataFrame([(None if i % 3 == 0 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = pieces.encode(docs, model).collect()
    assert sorted(list(x.piece_ids) for x in got) == sorted(sp.encode(t or "") for t in texts)
    assert all(x.round_trip and x.n_pieces == len(x.piece_ids) for x in got)
    rows = spark.createDataFrame([(1, sp.encode("a b")), (2, None), (3, [])], "doc_id long, piece_ids array<int>")
    assert {(x.doc_id, x.text) for x in pieces.decode(rows, model).collect()} == {(1, "a b"), (2, None), (3, "")}


@pytest.mark.parametrize("size", [3_000_000])
def test_large_payloads_share_an_archive(spark, size):
    r = random.Random(1)
    big = "".join(r.choices("abcdefgh <>", k=size))
    pages = spark.createDataFrame([(i, "http://x/", t) for i, t in enumerate([big, "small", big, big + "!", None])], "page_id long, url string, html string").coalesce(1)
    got = {x.page_id: (x.payload_bytes, x.record_type, x.refers_to) for x in warc.round_trip(pages).collect()}
    assert got == {0: (size, "response", None), 1: (5, "response", None), 2: (size, "revisit", 0), 3: (size + 1, "response", None), 4: (0, "response", None)}
