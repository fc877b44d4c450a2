"""The raw series table (id, time, value, period) from stored tables, and what is read beside it.

An adapter says which table and columns make series. Rows are ordered by the given keys, numbered
from 0 per id; the first half (2 * time < n) is period 0 (before), the rest is period 1 (after).
Null and NaN values are left out, ids without both periods too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.dialect import Dialect


@dataclass(frozen=True)
class Adapter:
    table: str
    id: str
    keys: str
    value: str
    #: Columns of the scan; anything else of the table is not read.
    columns: str

    def sql(self, d: Dialect) -> str:
        """CTEs that end in r: id, time, period, t (number in its period), n (length of the period), x."""
        return f"""
r0 AS (SELECT {self.id} AS id, {self.columns}, {self.value} AS x FROM {self.table} WHERE {self.value} IS NOT NULL AND NOT isnan({self.value})),
r1 AS (SELECT id, x, row_number() OVER (PARTITION BY id ORDER BY {self.keys}) - 1 AS time, count(*) OVER (PARTITION BY id) AS n_all FROM r0),
r2 AS (SELECT id, time, CASE WHEN 2 * time >= n_all THEN 1 ELSE 0 END AS period, n_all, x FROM r1 WHERE n_all >= 2),
r AS (SELECT id, time, period, CASE WHEN period = 1 THEN time - {d.div('n_all + 1', '2')} ELSE time END AS t,
             CASE WHEN period = 1 THEN n_all - {d.div('n_all + 1', '2')} ELSE {d.div('n_all + 1', '2')} END AS n, x FROM r2)"""


class Given(Adapter):
    """A table of raw series (id, time, value, period): the periods are given, times are numbered anew."""

    def sql(self, d: Dialect) -> str:
        return f"""
r0 AS (SELECT id, time AS given, CAST(period AS INT) AS period, value AS x FROM {self.table} WHERE value IS NOT NULL AND NOT isnan(value)),
r1 AS (SELECT id, period, x, row_number() OVER (PARTITION BY id ORDER BY period, given) - 1 AS time, row_number() OVER (PARTITION BY id, period ORDER BY given) - 1 AS t,
              count(*) OVER (PARTITION BY id, period) AS n, min(period) OVER (PARTITION BY id) AS low, max(period) OVER (PARTITION BY id) AS high FROM r0),
r AS (SELECT id, time, period, t, n, x FROM r1 WHERE low = 0 AND high = 1)"""


GIVEN = Given("series", "id", "time", "value", "time, period")
E1 = Adapter("events", "user_id", "ts, event_id", "value", "ts, event_id")
# Types are numbered from their distinct values, so that no window spans all rows.
_TYPES = "SELECT event_type AS kind, CAST(row_number() OVER (ORDER BY event_type) AS BIGINT) AS type_id FROM (SELECT DISTINCT event_type FROM events) kinds"
E2 = Adapter(f"(SELECT type_id, ts, event_id, value FROM events JOIN ({_TYPES}) typed ON event_type = kind)", "type_id", "ts, event_id", "value", "ts, event_id")
L1 = Adapter("lineitem", "l_suppkey", "l_shipdate, l_orderkey, l_linenumber", "l_extendedprice", "l_shipdate, l_orderkey, l_linenumber")
L2 = Adapter("lineitem", "l_suppkey", "l_shipdate, l_orderkey, l_linenumber", "l_quantity", "l_shipdate, l_orderkey, l_linenumber")

SERIES_SCHEMA = "id long, time int, value double, period int"


def read_series(spark: SparkSession, *paths: str) -> DataFrame:
    """A stored series table of one or many parts."""
    return spark.read.schema(SERIES_SCHEMA).parquet(*paths)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="id long")


def write_ids(ids: DataFrame, path: str) -> None:
    ids.select("id").orderBy("id").write.mode("overwrite").csv(path, header=True)


def rewrite_parts(spark: SparkSession, paths: list[str], target: str) -> None:
    """Several parts as one table."""
    read_series(spark, *paths).write.mode("overwrite").parquet(target)


def non_finite(df: DataFrame, limit: int = 5) -> DataFrame:
    """The first non-finite cells: column, value and the row's keys id and time."""
    found = None
    for name, kind in df.dtypes:
        if kind in ("float", "double"):
            c = F.col(name)
            bad = df.filter(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).select("id", "time", F.lit(name).alias("column"), c.cast("double").alias("value"))
            found = bad if found is None else found.unionByName(bad)
    if found is None:
        return df.select("id", "time", F.lit("").alias("column"), F.lit(0.0).alias("value")).limit(0)
    return found.limit(limit)


def complete_ids(series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Series of ids that have both periods, and the ids that haven't."""
    ids = series.groupBy("id").agg(F.min("period").alias("low"), F.max("period").alias("high"))
    whole = ids.filter("low = 0 AND high = 1").select("id")
    return series.join(whole, "id", "left_semi"), ids.join(whole, "id", "left_anti").select("id")


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the columns that hold numbers."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [name for name, kind in df.dtypes if kind in kinds or kind.startswith("decimal")]


def without_ids(df: DataFrame, ids: list[int]) -> DataFrame:
    """df without the rows of some ids; rows without an id stay."""
    return df.filter(~F.coalesce(F.col("id").isin(ids), F.lit(False)))


#: What most readers of a preprocessed table need.
ESSENTIAL = ["id", "time", "period", "standardized", "detrended"]


def write_essential(p: DataFrame, path: str) -> None:
    """The essential columns of a preprocessed table, by themselves."""
    p.select(*ESSENTIAL).write.mode("overwrite").parquet(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """id and prediction as 32-bit floats."""
    predictions.select("id", F.col("prediction").cast("float").alias("prediction")).write.mode("overwrite").parquet(path)


def holdout_split(labels: DataFrame, share: float = 0.04, seed: int = 42) -> DataFrame:
    """id, label, held: in each label the first rows by hash, share of them rounded up."""
    from pyspark.sql import Window

    slots = 1 << 12
    hashed = labels.select("id", "label", F.xxhash64("id", F.lit(seed)).alias("h")).withColumn("slot", F.shiftright("h", 52))
    counts = hashed.groupBy("label", "slot").agg(F.count("*").alias("n"))
    by_label = Window.partitionBy("label")  # at most `slots` rows a label
    offsets = counts.select("label", "slot", (F.sum("n").over(by_label.orderBy("slot")) - F.col("n")).alias("before"), F.sum("n").over(by_label).alias("all"))
    ranked = hashed.withColumn("own", F.row_number().over(Window.partitionBy("label", "slot").orderBy("h", "id"))).join(offsets, ["label", "slot"])
    return ranked.select("id", "label", (F.col("before") + F.col("own") <= F.ceil(F.col("all") * F.lit(share))).alias("held"))
