"""Stage 1: eleven derived series per id, as one chain of CTEs.

All statistics are those of the id's BEFORE half and serve both halves. Everything is partitioned
by id, so that after the first exchange windows, aggregates and joins on id share it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from driftline.functions.dialect import SPARK, Dialect
from driftline.sources.series import GIVEN, Adapter
from driftline.sources.workspace import bucket_count, fingerprint, listing, stored

#: Least spread of the standardised series, its first and second difference, and its absolute value.
FLOOR_Z, FLOOR_DIFF, FLOOR_ABS, FLOOR_DIFF2 = "0.0008216e0", "1.0909e0", "0.5555e0", "1.6383e0"
MAD_SCALE, CLIP_LOW, CLIP_HIGH, LEAST_WIDTH, WIDE = "1.4826e0", 0.002, 0.998, "1e0", "7e0"

SERIES = [
    "original", "standardized", "clipped", "detrended", "diff_standardized", "diff_detrended", "absdiff_detrended",
    "absval_detrended", "squared_detrended", "diff2_standardized", "diff2_detrended",
]


def _clipped(x: str) -> str:
    """x within its BEFORE quantiles, or within -7..7 where these are closer than 1."""
    narrow = f"hi_{x} - lo_{x} < {LEAST_WIDTH}"
    return f"least(greatest({x}, CASE WHEN {narrow} THEN -{WIDE} ELSE lo_{x} END), CASE WHEN {narrow} THEN {WIDE} ELSE hi_{x} END)"


def detrended(x: str) -> str:
    """Residual of the least squares line over t within (id, period)."""
    w = "OVER (PARTITION BY id, period)"
    middle = "(t - (n - 1) / 2e0)"
    return f"({x} - avg({x}) {w} - {middle} * sum({x} * {middle}) {w} / greatest((n * 1e0 * n - 1) * n / 12e0, 1e-9))"


def _exact_bounds(names: list[str], where: str) -> list[str]:
    """For Spark. y3: id and the bounds lo_x and hi_x of each series, with the last digit that the checking engine gives them: the spread of a window of
    clipped values is nothing but last digits. The arithmetic is that of blocks.exact_quantiles, for all series in one pass."""
    half = lambda c: f"134217729e0 * {c} - (134217729e0 * {c} - {c})"
    bounds = {f"{k}_{c}": (c, q) for c in names for k, q in (("lo", CLIP_LOW), ("hi", CLIP_HIGH))}
    each = lambda text: ", ".join(re.sub(r"#(\w+)", rf"\1_{b}", text) for b in bounds)
    step = lambda c, q: f"((size(v_{c}) - 1) * {q}e0)"
    placed = ", ".join(f"get(v_{c}, CAST(floor({i}) AS INT)) AS low_{b}, get(v_{c}, CAST(ceil({i}) AS INT)) AS high_{b}, {i} - floor({i}) AS f_{b}" for b, (c, q) in bounds.items() for i in [step(c, q)])
    found = ", ".join(
        f"CASE WHEN f_{b} = 0e0 THEN low_{b} WHEN abs(low_{b}) < 1e290 AND abs(s_{b}) < 1e290 THEN s_{b} + ((c_{b} - (s_{b} - (s_{b} - c_{b}))) + (d_{b} - (s_{b} - c_{b})) + rest_{b}) ELSE s_{b} END AS {b}" for b in bounds
    )
    return [
        f"y3v AS (SELECT id, {', '.join(f'sort_array(collect_list({c})) AS v_{c}' for c in names)} FROM y2 WHERE {where} GROUP BY id)",
        f"y3i AS (SELECT id, {placed} FROM y3v)",
        f"y3g AS (SELECT id, {each('#low, #high, #f, 1e0 - #f AS #g')} FROM y3i)",
        f"y3c AS (SELECT id, {each(f'#low, #f, #g, #low * #g AS #c, #high * #f AS #d, {half("#low")} AS #a, {half("#g")} AS #b')} FROM y3g)",
        f"y3s AS (SELECT id, {each('#low, #f, #c, #d, #c + #d AS #s, #a * #b - #c + #a * (#g - #b) + (#low - #a) * #b + (#low - #a) * (#g - #b) AS #rest')} FROM y3c)",
        f"y3 AS (SELECT id, {found} FROM y3s)",
    ]


def preprocess_sql(adapter: Adapter, d: Dialect) -> str:
    """CTEs that end in p: id, time, period, t, n and the series."""
    half = "period = 0"
    parts = [adapter.sql(d)]
    parts.append(f"z0 AS (SELECT id, median(x) AS m0 FROM r WHERE {half} GROUP BY id)")
    parts.append(f"z1 AS (SELECT r.id, max(m0) AS m0, greatest({MAD_SCALE} * median(abs(x - m0)), {FLOOR_Z}) AS s0 FROM r JOIN z0 ON r.id = z0.id WHERE {half} GROUP BY r.id)")
    parts.append("z2 AS (SELECT r.id, time, period, t, n, x, (x - m0) / s0 AS z FROM r JOIN z1 ON r.id = z1.id)")
    parts.append("z3 AS (SELECT *, coalesce(z - lag(z) OVER (PARTITION BY id, period ORDER BY t), 0e0) AS dz FROM z2)")
    parts.append("z4 AS (SELECT *, coalesce(dz - lag(dz) OVER (PARTITION BY id, period ORDER BY t), 0e0) AS ddz, abs(z) AS az, z * z AS q FROM z3)")
    parts.append(f"m1 AS (SELECT id, median(dz) AS m_d, median(ddz) AS m_dd, median(az) AS m_a FROM z4 WHERE {half} GROUP BY id)")
    spread = lambda c, floor: f"greatest({MAD_SCALE} * median(abs({c} - m_{'d' if c == 'dz' else 'dd' if c == 'ddz' else 'a'})), {floor})"
    parts.append(
        f"m2 AS (SELECT z4.id, max(m_d) AS m_d, max(m_dd) AS m_dd, max(m_a) AS m_a, {spread('dz', FLOOR_DIFF)} AS s_d, {spread('ddz', FLOOR_DIFF2)} AS s_dd, {spread('az', FLOOR_ABS)} AS s_a"
        f" FROM z4 JOIN m1 ON z4.id = m1.id WHERE {half} GROUP BY z4.id)"
    )
    parts.append("y1 AS (SELECT z4.id, time, period, t, n, x, z, q, (dz - m_d) / s_d AS d1, (ddz - m_dd) / s_dd AS d2, (az - m_a) / s_a AS a FROM z4 JOIN m2 ON z4.id = m2.id)")
    parts.append("y2 AS (SELECT *, abs(d1) AS ad FROM y1)")
    names = ["z", "d1", "ad", "a", "q", "d2"]
    if d.name == "spark":
        parts += _exact_bounds(names, half)
    else:
        bounds = ", ".join(f"{d.quantile(c, CLIP_LOW)} AS lo_{c}, {d.quantile(c, CLIP_HIGH)} AS hi_{c}" for c in names)
        parts.append(f"y3 AS (SELECT id, {bounds} FROM y2 WHERE {half} GROUP BY id)")
    clips = ", ".join(f"{_clipped(c)} AS c_{c}" for c in names)
    parts.append(f"y4 AS (SELECT y2.id, time, period, t, n, x, z, d1, d2, {clips} FROM y2 JOIN y3 ON y2.id = y3.id)")
    parts.append(
        "p AS (SELECT id, time, period, t, n, x AS original, z AS standardized, c_z AS clipped, "
        f"{detrended('c_z')} AS detrended, d1 AS diff_standardized, {detrended('c_d1')} AS diff_detrended, {detrended('c_ad')} AS absdiff_detrended, "
        f"{detrended('c_a')} AS absval_detrended, {detrended('c_q')} AS squared_detrended, d2 AS diff2_standardized, {detrended('c_d2')} AS diff2_detrended FROM y4)"
    )
    return ",\n".join(parts)


def build_preprocessed(spark: SparkSession, sf_dir: str, adapter: Adapter, force: bool = False) -> DataFrame:
    """The preprocessed table p of an adapter over the tables in sf_dir: stored in buckets by id, reused while its input and statement are the same."""
    name = re.search(r"\bFROM (\w+)", f"FROM {adapter.table}".replace("FROM (", "("))[1]
    path = f"{sf_dir}/{name}.parquet"
    text = f"WITH {preprocess_sql(adapter, SPARK)}\nSELECT * FROM p"
    key = fingerprint(spark, text, (path,))

    def build() -> DataFrame:
        return spark.sql(re.sub(rf"\bFROM {name}\b", "FROM {raw}", text), raw=spark.read.parquet(path))

    return stored(spark, key, build, "id", ["id", "period", "t"], bucket_count(spark, sum(size for _, size, _ in listing(spark, path))), force)


def preprocess_series(series: DataFrame, key: str) -> DataFrame:
    """The preprocessed table of raw series (id, time, value, period), stored under key. Ids without both periods are left out."""
    spark = series.sparkSession
    text = f"WITH {preprocess_sql(GIVEN, SPARK)}\nSELECT * FROM p"
    return stored(spark, key, lambda: spark.sql(text.replace("FROM series", "FROM {raw}"), raw=series), "id", ["id", "period", "t"], spark.sparkContext.defaultParallelism)


def prepared_sql(sql: str) -> str:
    """A statement over p and spectra with placeholders for the stored tables."""
    return re.sub(r"\b(FROM|JOIN) (p|spectra)\b( s\b)?", lambda m: f"{m[1]} {{{m[2]}}} AS {(m[3] or m[2]).strip()}", sql)
