"""All registered queries of the core engine and their oracle SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.dialect import DUCKDB, SPARK, Dialect
from driftline.operators import blocks, kernels, learning, selection
from driftline.operators.features import build_features, run_over
from driftline.operators.preprocess import build_preprocessed, preprocess_sql
from driftline.sources.series import E1, E2, L1, L2, Adapter, holdout_split
from driftline.sources.workspace import shared_folder

Query = Callable[[SparkSession, str], DataFrame]

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def run_sql(sql: str) -> Query:
    """A query over the stored tables that its text names."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)]
        text = sql
        for t in used:
            text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
        return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})

    return query


def over_prepared(sql: str, adapter: Adapter) -> Query:
    """A query over p, the stored preprocessed table of an adapter."""
    return lambda spark, sf_dir: run_over(spark, build_preprocessed(spark, sf_dir, adapter), sql)


#: Preprocessed columns by query name.
PREP = {
    "prep_standardized": "standardized", "prep_clipped": "clipped", "prep_detrended": "detrended", "prep_diff": "diff_standardized", "prep_diff_detrended": "diff_detrended",
    "prep_absdiff": "absdiff_detrended", "prep_absval": "absval_detrended", "prep_squared": "squared_detrended", "prep_diff2": "diff2_standardized", "prep_diff2_detrended": "diff2_detrended",
}
#: Series that a block's query reads; users' events unless listed.
ADAPTERS: dict[str, Adapter] = {"ks": L2, "js": L2, "rolling": L1, "boundary_local_w128": L1, "ewvar": L1, "ar1": L1, "glr_css": L1, "moments": L1}

_PREP_SELECT = "SELECT id, CAST(time AS BIGINT) AS time, CAST(period AS BIGINT) AS period, round({c}, 6) + 0e0 AS {c} FROM p"

# Sources, joins and looks at the data. The holdout list stands for a given id list: suppliers of the first five nations.
_HOLDOUT = "(SELECT s_suppkey AS id FROM supplier WHERE s_nationkey < 5) h"
_LENGTHS = "SELECT id, CAST(period AS BIGINT) AS period, count(*) AS length FROM r GROUP BY id, period"


def _looks(d: Dialect) -> dict[str, str]:
    series = lambda a: f"WITH {a.sql(d)}"
    row = "CAST(time AS BIGINT) AS time, CAST(period AS BIGINT) AS period, round(x, 6) AS value"
    half = lambda how: f"SELECT r.id, {row} FROM r LEFT {how} JOIN {_HOLDOUT} ON r.id = h.id" if d.name == "spark" else f"SELECT r.id, {row} FROM r {how} JOIN {_HOLDOUT} ON r.id = h.id"
    q = lambda p: d.quantile("length", p)
    stamp = "date_format(ts, 'MMdd_HHmm')" if d.name == "spark" else "strftime(ts, '%m%d_%H%M')"
    number = r"regexp_extract(props, '([0-9]+)', 1)"
    pieces = "split(props, ':')[0]" if d.name == "spark" else "split_part(props, ':', 1)"
    starts = "startswith" if d.name == "spark" else "starts_with"
    text = "STRING" if d.name == "spark" else "VARCHAR"
    return {
        "event_stamps": f"SELECT {stamp} AS stamp, event_type, count(*) AS n FROM events GROUP BY {stamp}, event_type",
        "props_parsed": f"SELECT event_id, CAST({number} AS BIGINT) AS number, trim({pieces}) AS key, {starts}(event_type, 'c') AS early, concat('id=', CAST(user_id AS {text}), ' k=', {number}) AS line FROM events",
        "series_long": f"{series(E1)}\nSELECT id, {row} FROM r",
        "series_by_type": f"{series(E2)}\nSELECT id, {row} FROM r",
        "semi_holdout": f"{series(L1)}\n{half('SEMI')}",
        "anti_holdout": f"{series(L1)}\n{half('ANTI')}",
        "union_split": f"{series(L1)},\na AS ({half('ANTI')}),\nb AS ({half('SEMI')})\nSELECT *, 'train' AS part FROM a UNION ALL SELECT *, 'holdout' AS part FROM b",
        "segment_lengths": f"{series(L1)}\n{_LENGTHS}",
        "series_summary": f"{series(L1)},\nl AS ({_LENGTHS})\nSELECT period, count(*) AS n, round(avg(length), 6) AS mean, round(stddev_samp(length), 6) AS sd, min(length) AS low, {q(0.25)} AS q25, {q(0.5)} AS q50, {q(0.75)} AS q75, max(length) AS high FROM l GROUP BY period",
        "break_times": f"{series(L1)}\nSELECT id, CAST(min(CASE WHEN period = 1 THEN time END) AS BIGINT) AS break_time, round({d.quantile('x', 0.005)}, 6) AS low, round({d.quantile('x', 0.995)}, 6) AS high FROM r GROUP BY id",
    }


def _over_p(d: Dialect) -> dict[str, tuple[str, Adapter]]:
    """Statements over p by name: (SELECT or CTEs and SELECT without WITH, adapter)."""
    cells = " UNION ALL ".join(f"SELECT '{c}' AS series, {c} AS v FROM p" for c in ("original", "standardized", "clipped", "detrended", "diff_standardized", "diff2_standardized"))
    return {
        "outlier_ids": ("SELECT DISTINCT id FROM p WHERE original < -5e0 OR original > 5e0", E1),
        "outlier_ids_diff2": ("SELECT DISTINCT id FROM p WHERE diff2_standardized < -2.1e0 OR diff2_standardized > 2.1e0", E1),
        "nonfinite_cells": (f"SELECT * FROM (SELECT id, time, series, v FROM ({cells.replace("SELECT '", "SELECT id, CAST(time AS BIGINT) AS time, '")}) u WHERE v IS NULL OR isnan(v) OR abs(v) > 1e300 ORDER BY id, time, series LIMIT 5) x", E1),
        "nonfinite_report": (f"SELECT series, count(*) AS cells, CAST(sum(CASE WHEN v IS NULL OR isnan(v) OR abs(v) > 1e300 THEN 1 ELSE 0 END) AS BIGINT) AS bad FROM ({cells}) u GROUP BY series", E1),
    }


# Selection works on all features that SQL expresses (three kernels are not among them), with a synthetic label, id % 2, as the tables have none for series.
COLUMNS = [c for make in blocks.BLOCKS.values() for c in make(DUCKDB).columns]


def _features_cte(d: Dialect) -> str:
    """CTEs that end in f (id and COLUMNS, rounded) and y (id, label)."""
    each = [f"f_{name} AS MATERIALIZED ({make(d).over_p()})" for name, make in blocks.BLOCKS.items()]
    first, *rest = [f"f_{name}" for name in blocks.BLOCKS]
    joined = first + "".join(f" JOIN {x} ON {first}.id = {x}.id" for x in rest)
    prep = preprocess_sql(E1, d).replace("\np AS (", "\np AS MATERIALIZED (")
    return f"WITH RECURSIVE {prep},\n" + ",\n".join(each) + f",\nf AS MATERIALIZED (SELECT {first}.id, {', '.join(COLUMNS)} FROM {joined}),\ny AS (SELECT id, CAST(id % 2 AS INT) AS label FROM f)"


def feature_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_features(spark, sf_dir, E1).select("id", *COLUMNS)


def _labels(f: DataFrame) -> DataFrame:
    return f.select("id", F.pmod("id", F.lit(2)).cast("int").alias("label"))


def _auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = feature_frame(spark, sf_dir)
    return selection.univariate_auc(f, _labels(f), COLUMNS).select("feature", F.round("auc", 6).alias("auc"))


def _auc_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("n_chars"), F.octet_length("text").cast("double").alias("n_bytes"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return selection.univariate_auc(docs, labels, ["n_chars", "n_bytes"]).select("feature", F.round("auc", 6).alias("auc"))


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _auc(spark, sf_dir).withColumn("score", F.round(F.abs(F.col("auc") - 0.5), 6))
    return scored.orderBy(F.desc("score"), "feature").limit(selection.TOP).filter(F.col("score") >= selection.LEAST_AUC - 0.5)


def _corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.correlated(selection.correlations(feature_frame(spark, sf_dir), COLUMNS)).select("f1", "f2", F.round("corr", 6).alias("corr"))


def _pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = selection.pruned(selection.correlations(feature_frame(spark, sf_dir), COLUMNS))
    return spark.createDataFrame([(n,) for n in names], "feature string")


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = feature_frame(spark, sf_dir)
    scaled = selection.scale(f, selection.fit_scale(f, COLUMNS))
    return scaled.select("id", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in COLUMNS))


_OOF = ["med_delta_oof", "slope_delta_oof", "std_vs_mad_oof", "kurt_contrast_oof"]


def _stack_sql(d: Dialect) -> tuple[list[str], str]:
    """Stacked logits of four fixed probabilities, made from the moments block."""
    lo, hi = "1e-5", "1e0 - 1e-5"
    logit = lambda c: f"(ln(least(greatest({c}, {lo}), {hi})) - ln(1e0 - least(greatest({c}, {lo}), {hi})))"
    mean = "(" + " + ".join(logit(c) for c in _OOF) + ") / 4e0"
    spread = " + ".join(f"power({logit(c)} - {mean}, 2e0)" for c in _OOF)
    block = blocks.BLOCKS["moments"](d)
    made = ", ".join(f"1e0 / (1e0 + exp(-1e0 * coalesce({block.columns[c.removesuffix('_oof')]}, 0e0))) AS {c}" for c in _OOF)
    out = ", ".join(f"round({logit(c)}, 6) + 0e0 AS {c}_logit" for c in _OOF)
    return [*block.ctes, f"oof AS (SELECT id, {made} FROM {block.source} GROUP BY id)"], f"SELECT id, {out}, round({mean}, 6) + 0e0 AS logit_mean, round(sqrt(({spread}) / 3e0), 6) + 0e0 AS logit_std FROM oof"


def _stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctes, _ = _stack_sql(SPARK)
    oof = run_over(spark, build_preprocessed(spark, sf_dir, L1), "WITH " + ",\n".join(ctes) + "\nSELECT * FROM oof")
    found = learning.stack_features(oof, _OOF)
    return found.select("id", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in found.columns if c != "id"))


def _seeds_sql(d: Dialect) -> tuple[list[str], str]:
    """The mean of the best two of three seeds' predictions by AUC, from fixed predictions."""
    ctes, _ = _stack_sql(d)
    each = " UNION ALL ".join(f"SELECT id, {i} AS seed, {c} AS p FROM oof" for i, c in enumerate(_OOF[:3]))
    return [
        *ctes, f"preds AS ({each})",
        "pr AS (SELECT seed, id, p, rank() OVER (PARTITION BY seed ORDER BY p) + (count(*) OVER (PARTITION BY seed, p) - 1) / 2e0 AS r FROM preds)",
        "pa AS (SELECT seed, (sum(CASE WHEN id % 2 = 1 THEN r ELSE 0e0 END) - sum(CASE WHEN id % 2 = 1 THEN 1e0 ELSE 0e0 END) * (sum(CASE WHEN id % 2 = 1 THEN 1e0 ELSE 0e0 END) + 1) / 2e0) AS won FROM pr GROUP BY seed)",
        "pb AS (SELECT seed FROM pa ORDER BY round(won, 6) DESC, seed LIMIT 2)",
    ], "SELECT id, round(avg(p), 6) AS p FROM preds JOIN pb ON preds.seed = pb.seed GROUP BY id"


def _rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """All 185 features with the label, and the features' names."""
    f = build_features(spark, sf_dir, E1)
    return f.join(_labels(f), "id"), [c for c in f.columns if c != "id"]


def _stack_of(spark: SparkSession, sf_dir: str) -> tuple[learning.Stack, DataFrame]:
    """The whole job as Config says: four families, five folds, three seeds of which two stay, five draws beside the defaults; stored by signature, so that queries share it."""
    rows, columns = _rows(spark, sf_dir)
    return learning.train(rows, columns, learning.Config(), f"{shared_folder(spark)}/driftline-stack"), rows


def _oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """family, id, p of all four families."""
    return reduce(DataFrame.unionByName, [b.oof.select(F.lit(b.family).alias("family"), "id", "p") for b in _stack_of(spark, sf_dir)[0].bases])


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stack_of(spark, sf_dir)[0].oof


def _infer(mode: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        stack, rows = _stack_of(spark, sf_dir)
        return learning.infer(stack, rows, mode)

    return query


def _components(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    f = build_features(spark, sf_dir, E1)
    return learning.principal_components(f, [c for c in f.columns if c != "id"])


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i + 1, v) for i, v in enumerate(_components(spark, sf_dir)[1])], "component long, share double")


def _holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all labelled documents, the first 4 % of each quality by hash."""
    return holdout_split(spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").alias("label")))


def _kernel(column: str, adapter: Adapter) -> Query:
    return lambda spark, sf_dir: kernels.kernel_columns(build_preprocessed(spark, sf_dir, adapter)).select("id", (F.round(column, 6) + F.lit(0.0)).alias(column))


def queries() -> dict[str, Query]:
    out = {name: run_sql(sql) for name, sql in _looks(SPARK).items()}
    out |= {name: over_prepared(sql, a) for name, (sql, a) in _over_p(SPARK).items()}
    out |= {name: over_prepared(_PREP_SELECT.format(c=c), E1) for name, c in PREP.items()}
    for name, block in blocks.BLOCKS.items():
        out[f"feat_{name}"] = over_prepared(block(SPARK).over_p(), ADAPTERS.get(name, E1))
    ctes, select = _seeds_sql(SPARK)
    return out | {
        "feat_mmd": _kernel("mmd2_rbf_idrband_equal", E1), "feat_arch_lm": _kernel("archlm_neglogp_delta", L1), "feat_dwt": _kernel("dwt_l3_energy_logratio", L1),
        "feat_spectral_fft": over_prepared(blocks.BLOCKS["spectral"](SPARK).over_p(), E2), "feat_all": lambda spark, sf_dir: build_features(spark, sf_dir, E1),
        "feat_all_outer": lambda spark, sf_dir: build_features(spark, sf_dir, E1, "full").select("id", *COLUMNS), "holdout_split": _holdout,
        "auc_univariate": _auc, "auc_documents": _auc_documents, "topk_features": _top, "corr_pairs": _corr, "corr_prune": _pruned, "scale_features": _scaled,
        "stack_features": _stack, "seed_average": over_prepared("WITH " + ",\n".join(ctes) + "\n" + select, L1),
        "oof_gbt": _oof, "meta_oof": _meta, "infer_full": _infer("full"), "infer_fold": _infer("fold"),
        "pca3": lambda spark, sf_dir: _components(spark, sf_dir)[0], "pca_variance": _explained,
    }


def oracle_sql() -> dict[str, str]:
    d = DUCKDB
    prep = lambda a: f"WITH {preprocess_sql(a, d)}"
    out = dict(_looks(d))
    out |= {name: f"{prep(a)}\n{sql}" for name, (sql, a) in _over_p(d).items()}
    out |= {name: f"{prep(E1)}\n{_PREP_SELECT.format(c=c)}" for name, c in PREP.items()}
    for name, block in blocks.BLOCKS.items():
        out[f"feat_{name}"] = block(d).sql(ADAPTERS.get(name, E1), d)
    with_f = _features_cte(d)
    auc = ",\n".join([with_f, *selection.auc_sql(COLUMNS)])
    pairs = f"{with_f},\n{selection.unpivot_sql(COLUMNS)},\ncorrs AS (SELECT a.feature AS f1, b.feature AS f2, CASE WHEN stddev_pop(a.value) > 0 AND stddev_pop(b.value) > 0 THEN corr(a.value, b.value) END AS corr FROM long a JOIN long b ON a.id = b.id AND a.feature < b.feature GROUP BY a.feature, b.feature)"
    docs = "WITH f AS (SELECT doc_id AS id, n_chars::DOUBLE AS n_chars, strlen(text)::DOUBLE AS n_bytes FROM documents), y AS (SELECT doc_id AS id, quality AS label FROM labels),\n"
    stack_ctes, stack = _stack_sql(d)
    seed_ctes, seeds = _seeds_sql(d)
    out |= {
        # The transform in Spark against sums over all frequencies.
        "feat_spectral_fft": blocks.BLOCKS["spectral"](d).sql(E2, d),
        "feat_mmd": prep(E1) + ",\n" + ",\n".join(kernels.mmd_sql()) + "\nSELECT id, round(mmd, 6) + 0e0 AS mmd2_rbf_idrband_equal FROM mq",
        "auc_univariate": f"{auc}\nSELECT feature, round(auc, 6) AS auc FROM auc",
        "auc_documents": docs + ",\n".join(selection.auc_sql(["n_chars", "n_bytes"])) + "\nSELECT feature, round(auc, 6) AS auc FROM auc",
        "topk_features": f"{auc}\nSELECT * FROM (SELECT feature, round(auc, 6) AS auc, round(abs(round(auc, 6) - 0.5), 6) AS score FROM auc ORDER BY score DESC, feature LIMIT {selection.TOP}) WHERE score >= {selection.LEAST_AUC - 0.5:.6f}",
        "corr_pairs": f"{pairs}\nSELECT f1, f2, round(corr, 6) AS corr FROM corrs WHERE abs(corr) > {selection.CORRELATED}",
        "corr_prune": f"{pairs},\n{selection.prune_sql()}",
        "scale_features": f"{with_f},\n{selection.scale_sql(COLUMNS)}",
        "feat_all_outer": f"{with_f}\nSELECT * FROM f",
        "stack_features": prep(L1) + ",\n" + ",\n".join(stack_ctes) + "\n" + stack,
        "seed_average": prep(L1) + ",\n" + ",\n".join(seed_ctes) + "\n" + seeds,
    }
    return out
