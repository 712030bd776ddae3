"""The pipeline on a small folder, stage by stage against plain versions."""

import random
import re

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from waymark.llm import quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    v = ["".join(r.choices("abcdefghijklmnopqrstuvw", k=r.randint(3, 9))) for _ in range(3000)]
    text = lambda n: " ".join(r.choices(v, k=n))
    item = text(30)
    rows = []
    for i in range(160):
        w = text(120).split()
        if i % 8 == 0:
            w[r.randrange(120)] = r.choice(["idiot", "scum", "moron"])
        rows.append((i, " ".join(w)))
    base = text(200)
    near = base.split()
    for at in (30, 80, 130, 180):
        near[at] = "changed"
    rows += [(500, base), (501, base), (502, " ".join(near)), (503, f"{text(60)} {item} {text(60)}"), (504, None), (505, ""), (506, "again and again " * 60), (None, text(130)), (507, text(120)), (507, text(120)), (508, text(40_000))]
    rows.append(rows[-2])
    path = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(i, t, None if i == 3 else "en", None, None if t is None else len(t), "more") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _id string")
    docs.repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(any(w in t for w in ("idiot", "scum", "moron")))) for i, t in rows[:160]], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def grams(text, n=5):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_every_stage_equals_a_plain_version(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    key = lambda rows: sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in rows)
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), "test")
        assert docs.columns == columns
        after[name] = docs.collect()
    first = spark.read.parquet(f"{folder}/documents.parquet").collect()
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter(corpus_pipeline.entries.id_remainder(3) != 1)
    model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), labels)
    calm = [r for r, s in zip(first, model.scores([r.text or "" for r in first]), strict=True) if s < 0.7]
    assert key(after["toxicity"]) == key(calm) and len(calm) < len(first)
    measured = quality.kept(spark.createDataFrame(calm, spark.read.parquet(f"{folder}/documents.parquet").schema)).collect()
    kept = after["quality rules"]
    assert key(kept) == key(measured) and not {504, 505, 506} & {r.doc_id for r in kept} and {500, 508} <= {r.doc_id for r in kept}
    sets = [(r, grams(r.text)) for r in kept]
    group = {}
    for r, s in sets:
        if r.doc_id is not None:
            group[r.doc_id] = min([o.doc_id for o, z in sets if o.doc_id is not None and s and z and 100 * len(s & z) >= 80 * len(s | z)] + [r.doc_id])
    one = {(r.doc_id, r.text) for r in kept if r.doc_id is None or group[r.doc_id] == r.doc_id}
    assert {(r.doc_id, r.text) for r in after["n-gram Jaccard join"]} == one and len(one) == len(after["n-gram Jaccard join"])
    assert not {501, 502} & {d for d, _ in one} and 500 in {d for d, _ in one}
    clean = after["benchmark decontamination"]
    assert {(r.doc_id, r.text) for r in clean} == {(d, t) for d, t in one if d != 503}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = sorted((r.doc_id or -1, list(r.piece_ids)) for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect())
    assert got == sorted((r.doc_id or -1, sp.encode(r.text)) for r in clean)
    ran = sorted((r.doc_id or -1, list(r.piece_ids)) for r in corpus_pipeline.run(spark, folder).collect())
    assert ran == got


def test_an_empty_table_stays_empty(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
