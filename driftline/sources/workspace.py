"""Stored intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import hashlib
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BUCKET_BYTES = 128 << 20


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or one of our own where it is unset and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="driftline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, size and time of the files of a stored table."""
    fs, target = _path(spark, path)
    files, out = fs.listFiles(target, True), []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def fingerprint(spark: SparkSession, *parts) -> str:
    """A digest of what a result depends on; a part (path,) stands for the files below it."""
    seen = [listing(spark, p[0]) if isinstance(p, tuple) else p for p in parts]
    return hashlib.md5(repr(seen).encode()).hexdigest()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    fs, target = _path(spark, f"{path}/_SUCCESS")
    return fs.exists(target)


_written: dict[str, SparkSession] = {}


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder until the driver's interpreter ends: its lineage is cut and its size is known."""
    path = f"{shared_folder(df.sparkSession)}/driftline-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = df.sparkSession
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for path, spark in _written.items():
        try:
            fs, target = _path(spark, path)
            fs.delete(target, True)
        except Exception:  # noqa: BLE001  the JVM may already be gone; the folder is then the cluster's to clean
            return


def bucket_count(spark: SparkSession, size: int) -> int:
    return max(spark.sparkContext.defaultParallelism, math.ceil(size / BUCKET_BYTES))


def stored(spark: SparkSession, key: str, build, by: str, order: list[str], buckets: int, force: bool = False) -> DataFrame:
    """The table of this key, built and written if there is none, in buckets by a column and sorted within them.

    Readers that group, join or window by that column need no further exchange. Tables that are
    joined should have as many buckets. A table counts only once its _SUCCESS file is there.
    """
    name, folder = f"driftline_{key}", f"{shared_folder(spark)}/driftline-table-{key}"
    fs, target = _path(spark, f"{folder}/{buckets}/_SUCCESS")
    if force or not fs.exists(target):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        fs.delete(target.getParent(), True)
        df = build()
        (df.repartition(buckets, by).write.mode("overwrite").format("parquet").option("path", f"{folder}/{buckets}")
           .bucketBy(buckets, by).sortBy(*order).saveAsTable(name))
    elif not spark.catalog.tableExists(name):
        schema = spark.read.parquet(f"{folder}/{buckets}").schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({', '.join(order)}) INTO {buckets} BUCKETS LOCATION '{folder}/{buckets}'")
    found = spark.table(name)
    found._driftline_buckets = buckets
    return found


def dropped(spark: SparkSession, key: str) -> None:
    """Forget a stored table."""
    spark.sql(f"DROP TABLE IF EXISTS driftline_{key}")
    fs, target = _path(spark, f"{shared_folder(spark)}/driftline-table-{key}")
    fs.delete(target, True)
