"""Univariate AUC, selection, scaling and correlation pruning, and looks at the data.

Statements take `f`, a wide feature table (id and doubles), and `y` (id, label).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.sources.workspace import written

TOP, LEAST_AUC, PLAIN = 60, 0.52, ("logit", "fisher", "logratio", "scaled")
CORRELATED, PRUNE = 0.95, 0.98


def unpivot_sql(columns: list[str]) -> str:
    """long: id, feature, value without nulls and non-finite numbers."""
    each = " UNION ALL ".join(f"SELECT id, '{c}' AS feature, {c} AS value FROM f" for c in columns)
    return f"long AS (SELECT * FROM ({each}) u WHERE value IS NOT NULL AND NOT isnan(value) AND abs(value) < 1e300)"


def auc_sql(columns: list[str]) -> list[str]:
    """CTEs that end in auc (feature, auc): rank form with mean ranks on ties; one class gives 1/2."""
    return [
        unpivot_sql(columns),
        "ranked AS (SELECT feature, label, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2e0 AS r FROM long JOIN y ON long.id = y.id)",
        "sums AS (SELECT feature, sum(CASE WHEN label = 1 THEN r ELSE 0e0 END) AS s, sum(CASE WHEN label = 1 THEN 1e0 ELSE 0e0 END) AS n1, sum(CASE WHEN label = 0 THEN 1e0 ELSE 0e0 END) AS n0 FROM ranked GROUP BY feature)",
        "auc AS (SELECT feature, CASE WHEN n1 = 0 OR n0 = 0 THEN 0.5e0 ELSE (s - n1 * (n1 + 1) / 2e0) / (n1 * n0) END AS auc FROM sums)",
    ]


def unpivot(features: DataFrame, columns: list[str]) -> DataFrame:
    """id, feature, value in one pass over the wide table."""
    long = features.select("id", *(F.col(c).cast("double").alias(c) for c in columns)).unpivot("id", columns, "feature", "value")
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < 1e300))


def univariate_auc(features: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """feature, auc. Rows are counted by value first; values are then sorted over all tasks, and a
    value's rank is its place in its task's sorted range plus the rows of the ranges before, so that
    no feature's values meet in one task."""
    values = unpivot(features, columns).join(labels, "id").groupBy("feature", "value").agg(F.count_if(F.expr("label = 1")).cast("double").alias("one"), F.count_if(F.expr("label = 0")).cast("double").alias("zero"))
    ranged = written(values.repartitionByRange("feature", "value").sortWithinPartitions("feature", "value").withColumn("range", F.spark_partition_id()), "ranks")
    up_to = Window.partitionBy("range", "feature").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    within = ranged.withColumn("below", F.sum("zero").over(up_to) - F.col("zero"))
    # Sorted ranges: as many rows as there are features and ranges together, at most.
    sums = ranged.groupBy("feature", "range").agg(F.sum("zero").alias("zeros"))
    before = F.sum("zeros").over(Window.partitionBy("feature").orderBy("range")) - F.col("zeros")
    offsets = written(sums.select(F.col("feature").alias("of"), F.col("range").alias("its"), before.alias("before")), "offsets")
    won = within.join(offsets, (F.col("feature") == F.col("of")) & (F.col("range") == F.col("its"))).withColumn("won", F.col("one") * (F.col("below") + F.col("before") + F.col("zero") / 2))
    sums = won.groupBy("feature").agg(F.sum("won").alias("won"), F.sum("one").alias("n1"), F.sum("zero").alias("n0"))
    return sums.select("feature", F.when((F.col("n1") == 0) | (F.col("n0") == 0), F.lit(0.5)).otherwise(F.col("won") / (F.col("n1") * F.col("n0"))).alias("auc"))


def selected(auc: DataFrame, k: int = TOP, least_auc: float = LEAST_AUC, always: tuple[str, ...] = ()) -> list[str]:
    """Names to keep: those always kept, then the best by |auc - 1/2|, ties by name. The table has a row per feature only."""
    rows = sorted(((-abs(r.auc - 0.5), r.feature) for r in auc.collect()))[:k]
    return [*always, *(name for score, name in rows if -score >= least_auc - 0.5 and name not in always)]


def excluded(columns: list[str], words: tuple[str, ...]) -> list[str]:
    """Columns whose names hold none of the words."""
    return [c for c in columns if not any(w.lower() in c.lower() for w in words)]


def correlations(features: DataFrame, columns: list[str]) -> DataFrame:
    """f1, f2, corr of every pair of columns, over the rows where both are finite; null where one is constant.

    One pass: each task adds up products of its rows, centred by the columns' means, as matrices, and
    sends one row a pair; these are summed by pair.
    """
    names = sorted(columns)
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    if not pairs:
        return features.sparkSession.createDataFrame([], "f1 string, f2 string, corr double")
    first, second = (np.array(x) for x in zip(*pairs, strict=True))
    plain = [F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c).cast("double")).alias(c) for c in names]
    means = features.select(*plain).agg(*(F.avg(c).alias(c) for c in names)).first()
    centre = np.array([means[c] or 0.0 for c in names])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((6, len(pairs)))
        for batch in batches:
            x = np.column_stack([np.asarray(batch.column(i).to_pandas(), float) for i in range(len(names))]) - centre
            ok = np.isfinite(x).astype(float)
            x = np.where(ok > 0, x, 0.0)
            q, each = x * x, lambda a, b: (a.T @ b)[first, second]
            sums += [each(ok, ok), each(x, ok), each(ok, x), each(q, ok), each(ok, q), each(x, x)]
        yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(second), *(pa.array(v) for v in sums)], names=["i", "j", *"nabcdp"])

    added = features.select(*plain).mapInArrow(products, "i long, j long, n double, a double, b double, c double, d double, p double").groupBy("i", "j").agg(*(F.sum(k).alias(k) for k in "nabcdp"))
    spread = lambda square, s: F.col(square) - F.col(s) * F.col(s) / F.col("n")
    both = spread("c", "a") * spread("d", "b")
    value = (F.col("p") - F.col("a") * F.col("b") / F.col("n")) / F.sqrt(both)
    corr = F.when((spread("c", "a") > 1e-12 * F.col("c")) & (spread("d", "b") > 1e-12 * F.col("d")), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))
    name = F.array(*(F.lit(c) for c in names))
    return added.select(F.get(name, F.col("i")).alias("f1"), F.get(name, F.col("j")).alias("f2"), corr.alias("corr"))


def correlated(corr: DataFrame, above: float = CORRELATED) -> DataFrame:
    """Pairs beyond the bound, the most alike first; ties by name."""
    return corr.filter(F.abs("corr") > above).orderBy(F.desc(F.round(F.abs("corr"), 6)), "f1", "f2")


def pruned(corr: DataFrame, above: float = PRUNE) -> list[str]:
    """Features to drop: going down the pairs by |corr| (to six digits, ties by name), the later name of each pair of which neither is dropped yet."""
    drop: set[str] = set()
    for r in correlated(corr, above).collect():  # a pair of columns each
        if r.f1 not in drop and r.f2 not in drop:
            drop.add(r.f2)
    return sorted(drop)


def prune_sql(above: float = PRUNE) -> str:
    """The same walk as CTEs after corrs (f1, f2, corr), and a select; for engines with recursion over lists."""
    return (
        f"walk AS (SELECT f1, f2, row_number() OVER (ORDER BY round(abs(corr), 6) DESC, f1, f2) AS i FROM corrs WHERE abs(corr) > {above}),\n"
        "steps AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS gone UNION ALL SELECT w.i, CASE WHEN list_contains(gone, f1) OR list_contains(gone, f2) THEN gone ELSE list_append(gone, f2) END FROM steps JOIN walk w ON w.i = steps.i + 1)\n"
        "SELECT unnest(gone) AS feature FROM (SELECT gone FROM steps ORDER BY i DESC LIMIT 1) x"
    )


def scaled_columns(columns: list[str]) -> list[str]:
    return excluded(columns, PLAIN)


def fit_scale(features: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of the columns that are scaled; a constant one has deviation 1."""
    own = scaled_columns(columns)
    row = features.agg(*(f(c).alias(f"{k}_{c}") for c in own for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first() if own else {}
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] if (row[f"s_{c}"] or 0) > 1e-9 else 1.0) for c in own}


def scale(features: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    """features with the fitted columns centred and scaled; others as they are. A missing column is an error."""
    return features.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in fitted.items()})


def scale_sql(columns: list[str]) -> str:
    """A select over f: population z-scores, but for features that are on a common scale already."""
    scaled = set(scaled_columns(columns))
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in scaled_columns(columns))
    out = ", ".join(f"round(({c} - m_{c}) / CASE WHEN s_{c} > 1e-9 THEN s_{c} ELSE 1e0 END, 6) + 0e0 AS {c}" if c in scaled else f"round({c}, 6) + 0e0 AS {c}" for c in columns)
    return f"st AS (SELECT {stats} FROM f)\nSELECT id, {out} FROM f JOIN st ON 1 = 1"
