"""What the training-data operators share: table access and written intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of the tables that are still there, with their sessions.
_written: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="driftline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back.

    Unlike an RDD checkpoint the table is compressed and its size is known to the planner, which
    then broadcasts it only below spark.sql.autoBroadcastJoinThreshold. The folder goes with free(),
    or when the driver's interpreter ends, as results are lazy and may read it until then.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/driftline-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written[path] = spark
    found = spark.read.schema(df.schema).parquet(path)
    found._driftline_path = path
    return found


def free(*tables: DataFrame) -> None:
    """Delete the folders of materialised tables that nothing will read any more."""
    for df in tables:
        path = df._driftline_path
        if spark := _written.pop(path, None):
            _delete(spark, path)


@contextmanager
def scoped() -> Iterator[list[DataFrame]]:
    """Tables that are materialised inside go at its end, but for those that are put into the list."""
    before, kept = set(_written), []
    yield kept
    stay = before | {df._driftline_path for df in kept}
    for path in [p for p in _written if p not in stay]:
        _delete(_written.pop(path), path)


def numbered(docs: DataFrame, label: str) -> DataFrame:
    """docs with a stored number of each row, driftline_row: the same however often and by however many tasks the table is read."""
    return materialise(docs.withColumn("driftline_row", F.monotonically_increasing_id()), label)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may already be gone; the folder is then the cluster's to clean
            return
