"""The folder that driver and executors share, and tables that are worked out once for each session."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


def new_folder(spark: SparkSession, label: str) -> str:
    """A path for a new folder below spark.checkpoint.dir. Where that is unset, a local session gets a
    folder of its own, which goes when Python ends; on a cluster the warehouse folder is used."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not base and (master == "local" or master.startswith("local[")):
        base = tempfile.mkdtemp(prefix="waymark-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    base = (base or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    return f"{base}/waymark-{label}-{uuid.uuid4().hex}"


#: By session, folder and stage: the state of the tables, where the stage lies, and its schema; and older ones, by session.
_STAGES: dict[tuple[str, str, str], tuple[str, str, object]] = {}
_OLD: list[tuple[str, str]] = []


def _place(spark: SparkSession, path: str):
    """(path, its file system) of Hadoop's."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def state(spark: SparkSession, folder: str) -> str:
    """What lies in a folder of tables, by name, size and time of change: other rows under the same path are another state."""
    at, fs = _place(spark, folder)
    return "|".join(sorted(f"{x.getPath().getName()}:{x.getLen()}:{x.getModificationTime()}" for x in fs.listStatus(at)))


def staged(build: Build) -> Build:
    """`build`'s table, written as Parquet in the shared folder when it is first asked for and read from
    there by every later query of the session over the same tables: plans stay short, no helper is
    worked out twice, and a lost executor costs nothing that was done before. Where the tables have
    changed the stage is made anew; the old one stays for frames that read it, until `release`."""

    @wraps(build)
    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, f"{build.__module__}.{build.__qualname__}")
        now = state(spark, sf_dir)
        if key not in _STAGES or _STAGES[key][0] != now:
            df, path = build(spark, sf_dir), new_folder(spark, build.__name__)
            df.write.option("compression", "zstd").parquet(path)
            if key in _STAGES:
                _OLD.append((key[0], _STAGES[key][1]))
            _STAGES[key] = now, path, df.schema
        _, path, schema = _STAGES[key]
        return spark.read.schema(schema).parquet(path)

    return get


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df`, written once to a new folder and read from there."""
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Remove all stages of this session and say how many there were. Frames that read them are of no use then."""
    own = spark.sparkContext.applicationId
    paths = [_STAGES.pop(k)[1] for k in [k for k in _STAGES if k[0] == own]] + [path for app, path in _OLD if app == own]
    _OLD[:] = [x for x in _OLD if x[0] != own]
    for path in paths:
        at, fs = _place(spark, path)
        fs.delete(at, True)
    return len(paths)


def cache_by_folder(build: Callable[[SparkSession, str], str]) -> Callable[[SparkSession, str], str]:
    """`build`'s path, worked out once for each session and folder of tables."""
    paths: dict[tuple[str, str], str] = {}

    @wraps(build)
    def get(spark: SparkSession, sf_dir: str) -> str:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in paths:
            paths[key] = build(spark, sf_dir)
        return paths[key]

    return get
