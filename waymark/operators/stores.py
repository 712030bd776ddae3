"""Files and stores: splits found by name, manifests, crosswalks with changing headers, graphs, vectors and reports
written and read back."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .graph import NODE_TYPES, RELATIONS, uuid5
from .vectors import normalised


def split_files(spark: SparkSession, files: DataFrame, schema: str, required: tuple[str, ...]) -> DataFrame:
    """The rows of a folder's CSV tables with their split, which each table's own name tells.

    files: (path) of the folders of tables. Exactly one must be named for each of train, validation and test, and each
    must have the required columns; what is wrong is raised before a row is read. The paths are a listing, not data."""
    paths = [r.path for r in files.select("path").orderBy("path").collect()]
    out = None
    for split in ("train", "validation", "test"):
        own = [p for p in paths if split in p.rstrip("/").rpartition("/")[2]]
        if len(own) != 1:
            raise ValueError(f"{len(own)} tables are named for {split}")
        lacks = set(required) - set(spark.read.option("header", True).csv(own[0]).columns)
        if lacks:
            raise ValueError(f"{own[0]} lacks {', '.join(sorted(lacks))}")
        rows = spark.read.schema(schema).option("header", True).csv(own[0]).select(*required, F.lit(split).alias("split"))
        out = rows if out is None else out.unionByName(rows)
    return out


#: Bytes that are read and hashed at a time.
CHUNK = 1 << 22


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of a JSON manifest {"files": {name: {"bytes": ..., "sha256": ...}}}; names are paths below its folder."""
    raw = spark.read.schema("files map<string, struct<bytes: bigint, sha256: string>>").json(path, multiLine=True)
    return raw.select(F.explode("files").alias("name", "x")).select("name", "x.bytes", "x.sha256")


def digests(files: DataFrame, folder: str) -> DataFrame:
    """files with has (its size) and digest (SHA-256 in lower case) of each file `name` below a folder; nulls where none is.

    A file is read as a stream of chunks by the task that holds its row, so its size doesn't matter."""
    schema = StructType([*files.schema.fields, StructField("has", LongType()), StructField("digest", StringType())])
    arrow = to_arrow_schema(schema)

    def one(fs: pa_fs.FileSystem, path: str) -> tuple[int | None, str | None]:
        info = fs.get_file_info(path)
        if info.type != pa_fs.FileType.File:
            return None, None
        h = hashlib.sha256()
        with fs.open_input_stream(path) as stream:
            while part := stream.read(CHUNK):
                h.update(part)
        return info.size, h.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa_fs.FileSystem.from_uri(folder)
        for batch in batches:
            found = [one(fs, f"{root.rstrip('/')}/{name}") for name in batch.column("name").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.string())], schema=arrow)

    return files.mapInArrow(run, schema)


def listing(spark: SparkSession, folder: str, hidden: bool = False) -> DataFrame:
    """(name) of all files below a folder, as paths below it; those that begin with a point or an underscore, or lie in such a
    folder, only if `hidden`. A listing holds names, no data; it's made where the query is built, as Spark's own listings are."""
    fs, root = pa_fs.FileSystem.from_uri(folder)
    root = root.rstrip("/")
    names = [x.path[len(root) + 1 :] for x in fs.get_file_info(pa_fs.FileSelector(root, recursive=True, allow_not_found=True)) if x.type == pa_fs.FileType.File]
    shown = [n for n in names if hidden or not any(part[0] in "._" for part in n.split("/"))]
    return spark.createDataFrame([(n,) for n in shown], "name string")


def verify_manifest(spark: SparkSession, folder: str, manifest: DataFrame, hidden: bool = False) -> DataFrame:
    """(name, status) of every file below a folder and of every entry of a manifest (name, bytes, sha256): ok, wrong size,
    wrong digest, missing or unlisted. Names are paths below the folder. Digests agree in either case. Only listed files
    are read; each is hashed where its entry lies."""
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    have = digests(manifest.select("name", "bytes", "sha256").repartition(slots, "name"), folder)
    status = (
        F.when(F.col("has").isNull(), "missing").when(F.col("bytes").isNull() | (F.col("has") != F.col("bytes")), "wrong size")
        .when(F.col("sha256").isNull() | (F.col("digest") != F.lower("sha256")), "wrong digest").otherwise("ok")
    )
    more = listing(spark, folder, hidden).join(manifest.select("name"), "name", "left_anti")
    return have.select("name", status.alias("status")).unionByName(more.select("name", F.lit("unlisted").alias("status")))


def crosswalk(rows: DataFrame) -> DataFrame:
    """(soc, isco, short) from a table whose headers merely contain those names; short is the soc code up to its point,
    taken from a column of that name where there is one."""
    of = lambda word: next((c for c in rows.columns if word in c.lower()), None)
    soc, isco = of("soc"), of("isco")
    if soc is None or isco is None:
        raise ValueError("no columns for soc and isco codes")
    short = F.trim(F.col("short")) if "short" in rows.columns else F.split(F.trim(F.col(f"`{soc}`")), r"\.")[0]
    return rows.select(F.trim(F.col(f"`{soc}`")).alias("soc"), F.trim(F.col(f"`{isco}`")).alias("isco"), short.alias("short")).filter("soc <> '' and isco <> ''")


def sink_graph(nodes: DataFrame, edges: DataFrame, folder: str, graph: str = "graph") -> None:
    """Nodes by type and edges by relation, each with its key; a type or relation that isn't allowed ends the job."""
    known = lambda c, allowed: F.when(F.col(c).isin(*allowed), F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"unknown {c}: "), F.coalesce(c, F.lit("null")))).cast("string"))
    nodes.withColumn("entity_key", F.concat_ws("::", F.lit(graph), "id")).withColumn("type", known("type", NODE_TYPES)).write.partitionBy("type").parquet(f"{folder}/nodes")
    key = F.concat_ws("::", F.lit(graph), "src", "relation", "dst", F.concat_ws(":", "source", "relation"))
    edges.withColumn("edge_key", key).withColumn("relation", known("relation", RELATIONS)).write.partitionBy("relation").parquet(f"{folder}/edges")


def sink_edges(edges: DataFrame, folder: str) -> None:
    """Edges as a store of kinds: a partition for each relation and source, so that one kind can be replaced alone."""
    edges.write.partitionBy("relation", "source").parquet(folder)


def replace_edges(nodes: DataFrame, new: DataFrame, folder: str, relation: str, source: str) -> None:
    """One kind of edges in a store of `sink_edges` replaced by `new` (same columns but relation and source); all others stay.

    `new` is written aside, and only when it's whole do the old files go and the new ones take their place, so a job
    that fails leaves the store as it was; repeating it changes nothing more. An empty `new` empties the kind. An end that
    is no node (id) ends the job before the store is touched."""
    spark = new.sparkSession
    aside = f"{folder}/_new-{uuid.uuid4().hex}"
    known = nodes.select(F.col("id"), F.lit(True).alias("known"))
    checked = new
    for end in ("src", "dst"):
        there = known.select(F.col("id").alias(end), F.col("known").alias("found"))
        lost = F.raise_error(F.concat(F.lit("no node is "), F.coalesce(end, F.lit("null")))).cast("string")
        checked = checked.join(there, end, "left").withColumn(end, F.when(F.col("found"), F.col(end)).otherwise(lost)).drop("found")
    checked.select(new.columns).write.parquet(aside)
    path = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x)
    place = path(f"{folder}/relation={relation}/source={source}")
    fs = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.delete(place, True)
    fs.mkdirs(place.getParent())
    if not fs.rename(path(aside), place):
        raise OSError(f"{aside} can't take the place of {place}")


def load_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges of a stored graph without what only the store needs."""
    return spark.read.parquet(f"{folder}/nodes").drop("entity_key"), spark.read.parquet(f"{folder}/edges").drop("edge_key")


def validate_graph(nodes: DataFrame, edges: DataFrame, expected: DataFrame, top: int = 5) -> DataFrame:
    """(check, name, n, ok) of a stored graph: its numbers beside the expected (kind, n), its relations, whether some role has
    requirements, and its `top` transitions by count."""
    n = nodes.agg(F.lit("nodes").alias("kind"), F.count("*").alias("n")).unionByName(edges.agg(F.lit("edges").alias("kind"), F.count("*").alias("n")))
    counts = n.join(expected.withColumnRenamed("n", "want"), "kind", "left").select(F.lit("count").alias("check"), F.col("kind").alias("name"), "n", F.coalesce((F.col("n") == F.col("want")) & (F.col("n") > 0), F.lit(False)).alias("ok"))
    relations = edges.groupBy(F.col("relation").alias("name")).agg(F.count("*").alias("n")).select(F.lit("relation").alias("check"), "name", "n", (F.col("n") > 0).alias("ok"))
    sample = edges.filter("relation = 'REQUIRES'").groupBy("src").agg(F.count("*").alias("n")).orderBy("src").limit(1).select(F.lit("requirements").alias("check"), F.col("src").alias("name"), "n", (F.col("n") > 0).alias("ok"))
    best = edges.filter("relation = 'TRANSITIONS_TO'").orderBy(F.desc("count"), "src", "dst").limit(top).select(F.lit("transition").alias("check"), F.concat("src", F.lit(" > "), "dst").alias("name"), F.col("count").alias("n"), F.lit(True).alias("ok"))
    return counts.unionByName(relations).unionByName(sample).unionByName(best)


def sink_vectors(roles: DataFrame, vectors: DataFrame, folder: str) -> None:
    """A point a role: UUID of its key, unit vector and a payload of what is known of it. An empty table and vectors of several
    sizes end the job."""
    good = normalised(vectors)
    size = good.agg(F.count("*").alias("n"), F.min(F.size("vec")).alias("lo"), F.max(F.size("vec")).alias("hi"))
    checked = size.select(F.when((F.col("n") > 0) & (F.col("lo") == F.col("hi")), F.col("lo")).otherwise(F.raise_error(F.lit("no vectors, or vectors of several sizes")).cast("int")).alias("dim"))
    optional = [c for c in roles.columns if c != "id"]
    payload = F.to_json(F.struct(F.col("id").alias("role_id"), *optional))
    points = good.join(roles, "id").crossJoin(F.broadcast(checked)).select(uuid5(F.concat(F.lit("role::"), F.col("id"))).alias("point_id"), "vec", "dim", payload.alias("payload"))
    points.write.parquet(folder)


def sink_reports(clean: DataFrame, counts: DataFrame, report: DataFrame, folder: str) -> None:
    """A cleaned split as Parquet, its counts as CSV and its report as JSON. Each is committed whole by Spark's writer."""
    clean.write.parquet(f"{folder}/clean")
    counts.write.option("header", True).csv(f"{folder}/counts")
    report.write.json(f"{folder}/report")
