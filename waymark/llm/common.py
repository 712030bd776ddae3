"""Shared places, table hand-over and Arrow helpers of the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows in an Arrow batch: texts may be long, so a batch is kept to few of them.
ARROW_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local session (tests) gets a folder of its own that goes when
    Python ends; on a cluster the warehouse folder is used, which is shared too.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local["):
        own = tempfile.mkdtemp(prefix="waymark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", own)
        return own
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/waymark-scratch"


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written as a Parquet table in the shared folder and read back: its lineage ends here,
    a lost executor costs no work done before, and later readers all see the same rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/waymark-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _TABLES[id(out)] = (out, path)
    return out


#: The tables of `stored` that are not released yet, by the frame that reads them.
_TABLES: dict[int, tuple[DataFrame, str]] = {}


def released(*frames: DataFrame) -> None:
    """Remove tables of `stored` that no later frame reads. Frames of other origin are left alone."""
    for df in frames:
        _, path = _TABLES.pop(id(df), (None, None))
        if path:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Keep Arrow batches to `rows` rows, so that a worker's memory follows the texts of a few rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def over_batches(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch that yields dicts of column values."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in f(batch):
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The batch's texts, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
