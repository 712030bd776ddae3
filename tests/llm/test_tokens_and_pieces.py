"""Token counts against their library, piece encoding against its library and a plain Viterbi."""

import itertools
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from waymark.llm import pieces, token_counts

ODD = ["'", "'s", "'ll", "a", "B", " ", "   ", "\n", "\t", "é", "٣", "5", "!", "中", "😀", "<|endoftext|>", "<|endof", " ", "'v", "e", "\r\n", "don't", "ſ", "Ⅷ", "x" * 30, "▁", "<s>", "<0x0A>", "the ", "\x00"]


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choices(ODD, k=r.randint(0, 40))) for _ in range(n)] + ["", " ", "\n", "a" * 3000, " " * 2500, "b c " * 3000]


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"))


def test_counts_equal_the_library(counter):
    some = texts(1500, 1)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert token_counts.count_texts(some, counter).tolist() == [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]


def test_blocks_of_long_texts_agree(counter, monkeypatch):
    some = [t * 7 for t in texts(60, 2)]
    whole = token_counts.count_texts(some, counter)
    monkeypatch.setattr(token_counts, "_BLOCK", 100)
    assert token_counts.count_texts(some, counter).tolist() == whole.tolist()


def test_prefix_scan_composes_maps_in_order():
    maps = np.random.default_rng(1).integers(0, 8, (37, 8)).astype(np.uint8)
    scanned, state = token_counts.prefix_scan(maps), np.arange(8)
    for m, got in zip(maps, scanned, strict=True):
        state = m[state]
        assert got.tolist() == state.tolist()


def test_token_counts_query_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (None, None, "y"), (1, "a b", "x"), (2, "é" * 1100, "z")], "doc_id long, text string, n_tokens string")
    got = token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got if r.doc_id != 2) == [(False, 1, 3, 2, False), (False, 1, 3, 2, False), (True, None, 0, 0, False)]
    assert [(r.n_bytes, r.over_limit) for r in got if r.doc_id == 2] == [(2200, True)]
    assert token_counts.token_counts(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).collect() == []


@pytest.fixture(scope="module")
def model():
    return public_tokenizers.path("piece_bpe_32k.model")


def test_encode_equals_the_library_and_decodes(spark, model, monkeypatch):
    some = texts(400, 3)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*some, None])], "doc_id long, text string, piece_ids string").repartition(3)
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    got = {r.doc_id: r for r in pieces.decode(pieces.encode(docs, model), model).collect()}
    for i, t in enumerate([*some, ""]):
        assert got[i].piece_ids == sp.encode(t)
        assert got[i].text == t.replace("▁", " ")
        assert got[i].round_trip == ("▁" not in t)
    assert pieces.encode(docs.limit(0), model).collect() == []


def test_lattice_fold_equals_the_tasks_fold(spark, model):
    p = pieces.load(model)
    units = sorted({u for t in texts(300, 4) for u in pieces.unit_pattern(p).findall(pieces.written(t)) if len(u) < 40})
    got = {r.unit: r.ids for r in pieces.encode_units(spark.createDataFrame([(u,) for u in units], "unit string"), p).collect()}
    whole = [u for u in units if all(c in p.scores for c in u)]
    assert set(got) == set(whole)
    assert all(got[u] == pieces.merge_unit(u, p) for u in whole)


def test_viterbi_equals_all_paths(spark):
    table = {"a": -1.0, "b": -1.5, "ab": -1.8, "ba": -3.0, "aba": -2.1, "c": -2.0, "abc": -9.0}
    p = pieces.Pieces({k: i for i, k in enumerate(table)}, table, [k.encode() for k in table], list(range(100, 356)), "unigram", 3)
    units = ["".join(x) for n in range(1, 6) for x in itertools.product("abc", repeat=n)]

    def paths(u):
        return [[]] if not u else [[q, *rest] for q in table if u.startswith(q) for rest in paths(u[len(q) :])]

    got = {r.unit: r.ids for r in pieces.encode_units(spark.createDataFrame([(u,) for u in units], "unit string"), p).collect()}
    for u in units:
        best = max(sum(table[x] for x in path) for path in paths(u))
        for ids in (got[u], pieces.viterbi_unit(u, p)):
            names = [list(table)[i] for i in ids]
            assert "".join(names) == u
            assert sum(table[x] for x in names) == pytest.approx(best)
