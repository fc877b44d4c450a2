"""Every block over one stored preprocessed table, joined by id."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.dialect import SPARK, libm_ln
from driftline.operators.blocks import BLOCKS
from driftline.operators.kernels import kernel_columns, spectra
from driftline.operators.preprocess import build_preprocessed, prepared_sql, preprocess_series
from driftline.sources.series import Adapter
from driftline.sources.workspace import dropped, fingerprint, stored

Made = Callable[[DataFrame], DataFrame]


def block_frame(spark: SparkSession, p: DataFrame, name: str) -> DataFrame:
    return run_over(spark, p, BLOCKS[name](SPARK).over_p())


def run_over(spark: SparkSession, p: DataFrame, sql: str) -> DataFrame:
    """A statement over p; one that reads spectra gets those of p, stored once."""
    text, tables = prepared_sql(sql), {"p": p}
    if "libm_ln(" in text:
        spark.udf.register("libm_ln", F.pandas_udf(lambda x: pd.Series(libm_ln(x)), "double"))
    if "{spectra}" in text:
        tables["spectra"] = stored(spark, fingerprint(spark, "spectra", sorted(p.inputFiles())), lambda: spectra(p), "id", ["id", "series", "period", "k"], p._driftline_buckets)
    return spark.sql(text, **tables)


def features_of(spark: SparkSession, p: DataFrame, key: str, how: str = "inner", force: bool = False, blocks: dict[str, Made] | None = None) -> DataFrame:
    """One row per id of a preprocessed table, stored in as many buckets by id.

    Each block is written by itself first: one plan over all blocks would be too large to optimise,
    and a lost executor then costs a block at most. The buckets make the joins free of exchanges.
    blocks: functions from p to a table with id and further columns, beside or, under an own name,
    in place of the registered ones; None takes a registered one out.
    """
    made: dict[str, Made] = {name: lambda q, name=name: block_frame(spark, q, name) for name in BLOCKS} | {"kernels": kernel_columns}
    made = {name: f for name, f in (made | (blocks or {})).items() if f is not None}
    parts = [stored(spark, fingerprint(spark, key, name), lambda f=f: f(p), "id", ["id"], p._driftline_buckets, force or name in (blocks or {})) for name, f in made.items()]
    joined = reduce(lambda left, right: left.join(right, "id", how), parts)
    out = stored(spark, fingerprint(spark, key, "all", how, sorted(made)), lambda: joined, "id", ["id"], p._driftline_buckets, force or bool(blocks))
    if how == "inner" and (found := out.count()) != (ids := p.select("id").distinct().count()):
        raise ValueError(f"{found} rows of features for {ids} ids")
    return out


def build_features(spark: SparkSession, sf_dir: str, adapter: Adapter, how: str = "inner", force: bool = False, blocks: dict[str, Made] | None = None) -> DataFrame:
    """One row per id with all 185 columns of an adapter's series, stored while its input stays the same."""
    p = build_preprocessed(spark, sf_dir, adapter, force)
    key = fingerprint(spark, sorted(p.inputFiles()), [BLOCKS[b](SPARK).over_p() for b in BLOCKS])
    return features_of(spark, p, key, how, force, blocks)


def series_features(series: DataFrame, key: str, **options) -> DataFrame:
    """The same for raw series (id, time, value, period). Tables are stored under key until forget(key)."""
    p = preprocess_series(series, fingerprint(series.sparkSession, key, "p"))
    return features_of(series.sparkSession, p, key, **options)


def forget(spark: SparkSession, key: str, how: str = "inner") -> None:
    """Delete what series_features stored under key."""
    names = [*BLOCKS, "kernels"]
    p = fingerprint(spark, key, "p")
    spectra_key = fingerprint(spark, "spectra", sorted(spark.table(f"driftline_{p}").inputFiles()))
    for k in [spectra_key, *(fingerprint(spark, key, n) for n in names), fingerprint(spark, key, "all", how, sorted(names)), p]:
        dropped(spark, k)


def as_float(features: DataFrame) -> DataFrame:
    """For export: 32-bit features."""
    return features.select("id", *(F.col(c).cast("float").alias(c) for c in features.columns if c != "id"))
