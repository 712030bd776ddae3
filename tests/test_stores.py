"""Stores and files: manifests, kinds of edges replaced, requirements and their evidence, and what held-out rows may not change."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from waymark.operators import ranker, scoring, stores


def test_manifest_statuses(spark, tmp_path):
    folder = tmp_path / "data"
    (folder / "sub").mkdir(parents=True)
    files = {"data.csv": b"a,b\n1,2\n", "part-1.csv": b"x", "part-2.csv": b"", "sub/part-1.csv": b"other", "sub/né #1.bin": bytes(range(256)), "size.txt": b"12", "digest.txt": b"12", "more.txt": b"?", "_note": b"h"}
    for name, body in files.items():
        (folder / name).write_bytes(body)
    good = {n: {"bytes": len(b), "sha256": hashlib.sha256(b).hexdigest().upper()} for n, b in files.items() if n not in ("more.txt", "_note")}
    good["size.txt"]["bytes"] = 3
    good["digest.txt"]["sha256"] = "0" * 64
    good["gone.csv"] = {"bytes": 1, "sha256": "0"}
    (tmp_path / "MANIFEST.json").write_text(json.dumps({"source": "here", "files": good}, indent=1))
    manifest = stores.read_manifest(spark, str(tmp_path / "MANIFEST.json"))
    for where in (str(folder), f"file://{folder}/"):
        got = dict(map(tuple, stores.verify_manifest(spark, where, manifest).collect()))
        odd = {"size.txt": "wrong size", "digest.txt": "wrong digest", "gone.csv": "missing", "more.txt": "unlisted"}
        assert got == {**{n: "ok" for n in good}, **odd}
    assert dict(map(tuple, stores.verify_manifest(spark, str(folder), manifest.limit(0), hidden=True).collect())) == {n: "unlisted" for n in files}


def test_a_file_above_two_gigabytes_is_hashed_as_a_stream(spark, tmp_path):
    size = (1 << 31) + 5
    with open(tmp_path / "large", "wb") as f:
        f.truncate(size)
    h = hashlib.sha256()
    for _ in range(size >> 20):
        h.update(bytes(1 << 20))
    h.update(bytes(size & ((1 << 20) - 1)))
    manifest = spark.createDataFrame([("large", size, h.hexdigest())], "name string, bytes long, sha256 string")
    assert [tuple(r) for r in stores.verify_manifest(spark, str(tmp_path), manifest).collect()] == [("large", "ok")]
    os.remove(tmp_path / "large")


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, relation string, source string, count long")


def test_kinds_of_edges_are_replaced_also_by_nothing(spark, tmp_path):
    folder = str(tmp_path / "edges")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    rows = [("a", "b", "T", "x", 1), ("b", "c", "T", "x", 2), ("a", "c", "T", "y", 3), ("a", "b", "S", "x", None)]
    stores.sink_edges(edges(spark, rows), folder)
    schema = "src string, dst string, count long, relation string, source string"
    read = lambda: sorted((r.src, r.dst, r.relation, r.source, r["count"]) for r in spark.read.schema(schema).parquet(folder).collect())
    new = lambda *r: spark.createDataFrame(list(r), "src string, dst string, count long")
    others = [("a", "b", "S", "x", None), ("a", "c", "T", "y", 3)]
    for some in ([("c", "a", 7)], [("c", "a", 7)], [("a", "b", 1), ("b", "a", 2), ("c", "b", 3)], []):
        stores.replace_edges(nodes, new(*some), folder, "T", "x")
        assert read() == sorted(others + [(x, y, "T", "x", n) for x, y, n in some])
    stores.replace_edges(nodes, new(("b", "c", 4)), folder, "NEW", "z")
    whole = read()
    assert ("b", "c", "NEW", "z", 4) in whole
    with pytest.raises(Exception, match="no node is q"):
        stores.replace_edges(nodes, new(("b", "q", 4)), folder, "T", "y")
    assert read() == whole


def test_requirements_of_aligned_roles_without_skills(spark):
    nodes = spark.createDataFrame([("e1", "esco"), ("e2", "esco"), ("o1", "onet"), ("o2", "onet"), ("o3", "onet"), ("o4", "onet"), ("z", "other")], "id string, source string")
    need = [("e1", "s1", "esco", "essential", None), ("e1", "s2", "esco", "optional", None), ("o1", "s3", "onet", None, 4.0), ("o2", "s3", "onet", None, 4.0), ("o3", "s3", "onet", None, 3.5), ("o3", "s4", "onet", None, 3.4), ("z", "s1", "esco", "essential", None)]
    requires = spark.createDataFrame(need, "src string, dst string, source string, requirement_level string, importance double")
    pairs = spark.createDataFrame([("o1", "e1", 0.5), ("o1", "e2", 0.4), ("e2", "o2", 0.7), ("e1", "o2", 0.7)], "id string, nbr string, similarity double")
    best = {r.id: (r.partner, r.similarity) for r in scoring.strongest(pairs).collect()}
    assert best["o1"] == ("e1", 0.5) and best["o2"] == ("e2", 0.7)  # of equals the greater id
    like = scoring.strongest(pairs).filter("id like 'o%'")
    got = scoring.role_requirements(nodes, requires, like)
    assert sorted(map(tuple, got.collect())) == [("e1", "s1", "direct_esco", "e1"), ("o1", "s1", "aligned_esco", "e1"), ("o3", "s3", "direct_onet", "o3")]
    status = {r.role: (r.status, r.evidence, r.skills) for r in scoring.requirement_status(nodes, like, got).collect()}
    assert status == {
        "e1": ("direct_esco", "e1", 1), "e2": ("no_requirements", "e2", 0), "o1": ("aligned_esco", "e1", 1), "o2": ("no_requirements", "e2", 0),
        "o3": ("direct_onet", "o3", 1), "o4": ("no_esco_alignment", "o4", 0), "z": ("unsupported_role_source", None, 0),
    }


def test_weeks_of_an_unknown_band(spark):
    rows = spark.createDataFrame([(0, None), (0, "low"), (0, "moderate"), (0, "high"), (1, None), (3, "high")], "missing long, band string")
    low, high = scoring.upskill_weeks(F.col("missing"), F.col("band"))
    assert [tuple(r) for r in rows.select(low, high).collect()] == [(4, 12), (4, 12), (12, 36), (36, 72), (3, 7), (9, 21)]


def test_held_out_people_change_no_feature(spark, tmp_path):
    """Rows of the ranker are the same when the orders of all people of the other splits are gone."""
    from waymark.plans import learning_queries as q

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables here")
    for name in ("lineitem", "part", "supplier", "embeddings", "nation"):
        os.symlink(f"{data}/{name}.parquet", tmp_path / f"{name}.parquet")
    orders = spark.read.parquet(f"{data}/orders.parquet")
    orders.filter("o_custkey % 10 <= 7").write.parquet(f"{tmp_path}/orders.parquet")
    columns = ["src", "dst", *ranker.FEATURES]
    rows = lambda d: sorted(map(tuple, q.ranker_features(spark, d).select(columns).collect()))
    whole = rows(data)
    assert whole and whole == rows(str(tmp_path)) and any(r[columns.index("aux_count")] for r in whole)
