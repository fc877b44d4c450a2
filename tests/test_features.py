"""Features against a plain numpy restatement, on series with ties, constants and short halves."""

import math

import numpy as np
import pytest

from driftline.functions.dialect import SPARK
from driftline.operators import kernels
from driftline.operators.features import as_float, block_frame, build_features
from driftline.operators.preprocess import SERIES, build_preprocessed
from driftline.sources.series import E1

EPS = 1e-9


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(3)
    out = {i: rng.normal(5, 2, 60 + 7 * i) for i in range(1, 6)}
    out[6] = np.round(rng.normal(0, 2, 90))
    out[7] = np.concatenate([rng.normal(0, 1, 250), rng.normal(3, 4, 250)])
    out[8] = np.full(50, 5.0)
    out[9] = np.array([1.0, 2.0, 4.0])
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, values):
    path = tmp_path_factory.mktemp("data")
    rng = np.random.default_rng(1)
    rows = [(i, k, float(v)) for i, x in values.items() for k, v in enumerate(x)] + [(1, 10_000, None), (2, 10_001, float("nan")), (99, 1, 1.0)]
    rng.shuffle(rows)
    rows = [(int(i), int(k), None if v is None else float(v)) for i, k, v in rows]
    spark.createDataFrame(rows, "user_id long, event_id long, value double").selectExpr("user_id", "event_id", "timestamp_seconds(event_id) ts", "value").write.parquet(f"{path}/events.parquet")
    return str(path)


@pytest.fixture(scope="module")
def prepared(spark, folder):
    return build_preprocessed(spark, folder, E1)


def mad(x):
    return np.median(np.abs(x - np.median(x)))


def prep(x):
    nb = (len(x) + 1) // 2
    halves = slice(0, nb), slice(nb, None)

    def standard(v, floor):
        b = v[:nb]
        return (v - np.median(b)) / max(1.4826 * mad(b), floor)

    def clip(v):
        lo, hi = np.quantile(v[:nb], [0.002, 0.998])
        return np.clip(v, -7, 7) if hi - lo < 1 else np.clip(v, lo, hi)

    def line(v):
        out = np.empty_like(v)
        for h in halves:
            y = v[h]
            t = np.arange(len(y)) - (len(y) - 1) / 2
            out[h] = y - y.mean() - t * (t @ y) / max(t @ t, EPS)
        return out

    diff = lambda v: np.concatenate([np.diff(v[h], prepend=v[h][0]) for h in halves])
    z = standard(x, 0.0008216)
    d, dd = diff(z), diff(diff(z))
    d1, d2, a = standard(d, 1.0909), standard(dd, 1.6383), standard(np.abs(z), 0.5555)
    made = [x, z, clip(z), line(clip(z)), d1, line(clip(d1)), line(clip(np.abs(d1))), line(clip(a)), line(clip(z * z)), d2, line(clip(d2))]
    return nb, dict(zip(SERIES, made, strict=True))


def test_series(prepared, values):
    rows = prepared.orderBy("id", "time").collect()
    assert {r.id for r in rows} == set(values)
    for i, x in values.items():
        nb, want = prep(x)
        own = [r for r in rows if r.id == i]
        assert [r.period for r in own] == [0] * nb + [1] * (len(x) - nb)
        for name in SERIES:
            assert np.allclose([r[name] for r in own], want[name], atol=1e-8), (i, name)


def logit(k, n):
    p = min(max((k + 0.5) / (n + 1), EPS), 1 - EPS)
    return math.log(p / (1 - p))


def acf(x, lags):
    c = x - x.mean()
    return [0.0 if c @ c <= 0 else (c[k:] @ c[:-k]) / ((len(c) - k) * c.var()) for k in range(1, lags + 1)]


def ks(b, a):
    both = sorted([(v, 0) for v in b] + [(v, 1) for v in a])
    gap, n = 0.0, [0, 0]
    for _, side in both:
        n[side] += 1
        gap = max(gap, abs(n[0] / len(b) - n[1] / len(a)))
    s = math.sqrt(max(len(b) * len(a) / (len(b) + len(a)), 1))
    return (s + 0.12 + 0.11 / s) * gap


def js(b, a):
    edges = np.unique(np.quantile(b, np.linspace(0, 1, 33)))
    if len(edges) < 2:
        return 0.0
    p, q = (np.histogram(x, bins=edges)[0] + 0.5 for x in (b, a))
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    return 0.5 * float((p * np.log(p / m)).sum() + (q * np.log(q / m)).sum())


def entropy(x, m):
    if len(x) < m:
        return 0.0
    codes = [tuple(np.argsort(np.argsort(x[i : i + m], kind="stable"), kind="stable")) for i in range(len(x) - m + 1)]
    p = np.unique(codes, axis=0, return_counts=True)[1] / len(codes)
    return float(-(p * np.log(p + EPS)).sum() / (math.log(math.factorial(m)) + EPS))


def column(spark, prepared, block, name):
    return {r.id: r[name] for r in block_frame(spark, prepared, block).select("id", name).collect()}


def close(got, want, skip=()):
    for i, w in want.items():
        if i not in skip:
            assert got[i] == pytest.approx(w, abs=3e-6), i


LONG = {1, 2, 3, 4, 5, 6, 7}


def test_blocks(spark, prepared, values):
    z = {i: (p["standardized"][:nb], p["standardized"][nb:]) for i, (nb, p) in ((i, prep(x)) for i, x in values.items())}
    t = {i: (p["detrended"][:nb], p["detrended"][nb:]) for i, (nb, p) in ((i, prep(x)) for i, x in values.items())}
    on = lambda f, of=z: {i: f(*of[i]) for i in LONG}
    close(column(spark, prepared, "moments", "med_delta"), on(lambda b, a: np.median(a) - np.median(b)))
    close(column(spark, prepared, "moments", "std_vs_mad"), on(lambda b, a: math.log(a.std() / (1.4826 * mad(a) + EPS)) - math.log(b.std() / (1.4826 * mad(b) + EPS))))
    close(column(spark, prepared, "quantiles", "Q95_delta"), on(lambda b, a: np.quantile(a, 0.95) - np.quantile(b, 0.95)))
    close(column(spark, prepared, "rates", "abs_excd_3_logit_delta"), on(lambda b, a: logit((abs(a) > 3).sum(), len(a)) - logit((abs(b) > 3).sum(), len(b))))
    close(column(spark, prepared, "autocorr", "acf2_delta"), on(lambda b, a: acf(a, 2)[1] - acf(b, 2)[1], t))
    close(column(spark, prepared, "ks", "ks_norm"), on(ks))
    close(column(spark, prepared, "js", "js_divergence"), on(js))
    close(column(spark, prepared, "perm_entropy", "perm_entropy_m3_delta"), on(lambda b, a: entropy(a, 3) - entropy(b, 3)))
    close(column(spark, prepared, "glr_css", "css_norm"), on(lambda b, a: math.sqrt(len(y := np.concatenate([b, a]))) * np.abs(np.cumsum(y * y) / (y @ y) - np.arange(1, len(y) + 1) / len(y)).max()))
    close(column(spark, prepared, "boundary_edge", "edge_dz_o8"), on(lambda b, a: np.median(a[8:13]) - np.median(b[-5:])))


def rolling_logstd(x, w):
    s = np.array([math.log(x[i : i + w].std() + EPS) for i in range(len(x) - w + 1)])
    jump = s[w:] - s[:-w]
    return jump.max(), jump.min(), np.sort(abs(jump))[-3:].mean()


def test_rolling(spark, prepared, values):
    got = {r.id: r for r in block_frame(spark, prepared, "rolling").collect()}
    nb, p = prep(values[7])
    for w in (10, 50):
        b, a = (rolling_logstd(x, w) for x in (p["clipped"][:nb], p["clipped"][nb:]))
        for k, name in enumerate(("maxpos", "maxneg", "topkabs_mean")):
            assert got[7][f"roll_logstd_jump_w{w}_{name}_delta"] == pytest.approx(a[k] - b[k], abs=1e-5)
    assert all(got[7][c] == 0 for c in got[7].asDict() if "_w200_" in c)  # too few positions
    assert all(got[9][c] == 0 for c in got[9].asDict() if "roll_" in c)


def test_kernels():
    assert np.allclose(kernels.LOW @ kernels.LOW, 1) and np.allclose(kernels.LOW @ kernels.HIGH, 0) and np.allclose(kernels.HIGH.sum(), 0)
    x = np.random.default_rng(2).normal(size=256)
    low, high = kernels.dwt(x)
    inner = slice(2, -2)
    assert abs(np.square(low).sum() + np.square(high).sum() - np.square(x).sum()) < 0.1 * np.square(x).sum()
    assert np.allclose(kernels.dwt(np.arange(64.0))[1][inner], 0)  # two vanishing moments
    assert kernels.arch_lm(np.arange(6.0)) == 0 and kernels.gamma_upper(2.5, 0) == 1
    assert kernels.gamma_upper(2.5, 11.0705 / 2) == pytest.approx(0.05, abs=1e-5)
    for y in (0.1, 1.0, 2.4, 3.6, 8.0, 40.0):  # closed forms for five and for two degrees of freedom
        five = math.erfc(math.sqrt(y)) + 2 * math.sqrt(y / math.pi) * math.exp(-y) * (1 + 2 * y / 3)
        assert kernels.gamma_upper(2.5, y) == pytest.approx(five, rel=1e-10) and kernels.gamma_upper(1.0, y) == pytest.approx(math.exp(-y), rel=1e-12)
    assert kernels.mmd2(x, x) > 0 and kernels.mmd2(x[:1], x) == 0


def test_build_features(spark, folder, values):
    f = build_features(spark, folder, E1)
    assert f.count() == len(values) and len(f.columns) == 1 + 185
    assert dict(as_float(f).dtypes)["med_delta"] == "float"
    again = build_features(spark, folder, E1)
    assert again.inputFiles() == f.inputFiles()  # reused


def test_no_exchange_over_the_stored_table(spark, prepared):
    from driftline.operators.blocks import BLOCKS
    from driftline.operators.preprocess import prepared_sql

    for block in ("autocorr", "moments", "rolling"):
        df = spark.sql(prepared_sql(BLOCKS[block](SPARK).over_p()), p=prepared)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan, block


def test_own_blocks_and_outer_join(spark, folder, values):
    from pyspark.sql import functions as F

    longest = lambda p: p.filter("id <> 9").groupBy("id").agg(F.max("time").cast("double").alias("last"))
    f = build_features(spark, folder, E1, how="full", blocks={"last": longest, "rolling": None})
    got = {r.id: r["last"] for r in f.collect()}
    assert got == {i: None if i == 9 else len(x) - 1 for i, x in values.items()}
    assert len(f.columns) == 1 + 185 - 45 + 1
    with pytest.raises(ValueError, match="8 rows of features for 9 ids"):
        build_features(spark, folder, E1, blocks={"last": longest, "rolling": None})


def test_furthest_edge_of_equal_sizes_and_unlike_signs_is_that_of_the_checking_engine(spark):
    """Rank logits like ln(3) and ln(1/3) tie but for the last digit of the logarithm."""
    import duckdb
    import pandas as pd

    from driftline.functions.dialect import DUCKDB
    from driftline.operators.blocks import BLOCKS
    from driftline.operators.features import run_over

    halves = [14, 38, 30, 21, 17, 10, 3, 6, 20, 15, 35, 8, 48, 50, 41, 19, 23, 45, 29, 26, 24, 28, 4, 7, 22], [12, 40, 43, 9, 33, 25, 46, 16, 5, 47, 27, 42, 32, 49, 37, 18, 13, 44, 11, 1, 39, 36, 2, 31, 34]
    rows = [(1, period, t, len(half), float(v)) for period, half in enumerate(halves) for t, v in enumerate(half)]
    p = pd.DataFrame(rows, columns=["id", "period", "t", "n", "standardized"])
    want = duckdb.sql(BLOCKS["boundary_edge"](DUCKDB).over_p()).df().sort_values("id", ignore_index=True)
    assert want.edge_ranklogit_max_abs[0] == pytest.approx(1.098612)
    got = run_over(spark, spark.createDataFrame(p), BLOCKS["boundary_edge"](SPARK).over_p()).toPandas().sort_values("id", ignore_index=True)
    pd.testing.assert_frame_equal(got, want[list(got.columns)], check_exact=True, check_dtype=False)


def differs_from_its_sql(spark, path, query, ids):
    """Whether a query over the events of some series (id: values) is not, to its last digit, what the checking engine finds."""
    import duckdb
    import pandas as pd

    from driftline.plans import catalog

    rows = [(i, k, float(v)) for i, x in ids.items() for k, v in enumerate(x)]
    spark.createDataFrame(rows, "user_id long, event_id long, value double").selectExpr("user_id", "event_id", "timestamp_seconds(event_id) ts", "value").write.parquet(f"{path}/events.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
        want = con.execute(catalog.oracle_sql()[query]).df().sort_values("id", ignore_index=True)
    got = catalog.queries()[query](spark, str(path)).toPandas().sort_values("id", ignore_index=True)
    assert len(want) == len(ids) and list(got.columns) == list(want.columns)
    try:
        pd.testing.assert_frame_equal(got, want, check_exact=True, check_dtype=False)
    except AssertionError:
        return True
    return False


def test_boundary_local_counts_values_at_a_level_like_the_checking_engine(spark, tmp_path):
    """A value of AFTER lies on the line between the two of BEFORE that the 95 % quantile is taken from."""
    x = [60.1, 10.28, 89.99, 18.29, 20.57, 29.07, 83.45, 41.19, 64.03, 24.2, 65.27, 1.03, 38.04, 3.89, 10.79, 62.59, 17.4, 47.09, 1.0, 66.29, 9.82, 19.22, 8.06, 37.67, 60.17, 38.13, 15.71, 24.85, 20.99, 67.39, 10.18, 97.79, 76.5, 145.63, 55.81, 3.85, 91.94, 89.61, 36.32, 40.49, 2.32, 12.28, 15.29, 108.87, 5.46, 35.49, 61.14, 77.5, 5.82, 67.17, 16.45, 25.38, 49.96, 117.83, 36.84, 48.59, 37.44, 62.33, 2.43, 18.76, 128.51, 1.25, 0.78, 62.62, 13.67, 9.94, 36.73, 83.3, 48.38, 45.17, 27.27]
    assert not differs_from_its_sql(spark, tmp_path, "feat_boundary_local_w32", {1: x})


def test_differences_count_values_at_a_level_like_the_checking_engine(spark, tmp_path):
    """Differences of AFTER that lie on the line between the two of BEFORE that the 5 % quantile is taken from, beyond it and not."""
    x = [52.13, 70.38, 127.42, 136.16, 33.27, 120.83, 10.2, 129.9, 54.01, 69.39, 46.62, 36.5, 64.03, 104.12, 1.23, 42.56, 21.25, 35.31, 13.6, 28.29, 27.8, 8.15, 9.08, 69.3, 3.86, 87.11, 108.39, 19.52, 44.35, 105.76, 42.48, 42.27, 110.51, 149.07, 113.81, 16.85, 48.96, 124.33, 42.88, 19.46, 10.28, 29.28, 42.0, 66.19, 67.12, 1.73, 74.89, 1.41, 12.51, 70.9, 20.15, 15.7, 4.95, 89.65, 131.83, 17.99, 22.3, 186.16, 38.24, 1.2]
    y = [30.72, 38.5, 78.86, 33.29, 5.56, 61.17, 24.68, 124.09, 23.82, 63.67, 77.01, 3.9, 67.06, 33.38, 100.04, 34.46, 34.89, 33.83, 6.61, 18.18, 31.16, 73.56, 0.45, 44.87, 81.74, 14.53, 74.35, 14.93, 2.19, 10.63, 46.84, 63.86, 6.78, 10.75, 36.49, 63.55, 17.96, 2.43, 19.96, 119.93, 64.5, 15.61, 28.57, 20.16, 92.69, 9.99, 5.89, 67.8, 40.6, 152.4, 64.72, 22.67, 15.69, 20.35, 20.55, 44.51, 43.71, 27.49, 19.1, 61.24, 39.24, 61.0, 25.88, 21.96, 14.83, 28.6, 50.58, 32.46, 39.64, 41.42, 149.7, 78.82, 62.62, 20.93]
    assert not differs_from_its_sql(spark, tmp_path, "feat_differences", {1: x, 2: y})


def test_differences_without_bounds_are_nan_like_those_of_the_checking_engine(spark, tmp_path):
    """Not null: pandas takes the two for the same, so nulls are counted by themselves."""
    import duckdb

    from driftline.plans import catalog

    x = [5.0, 2.5, np.inf, 3.0, 4.0, 5.5, 1.0, 2.0]
    assert not differs_from_its_sql(spark, tmp_path, "feat_differences", {1: x, 2: x[3:]})
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        want = con.execute(catalog.oracle_sql()["feat_differences"]).fetchall()
    got = catalog.queries()["feat_differences"](spark, str(tmp_path)).collect()
    assert {r[0]: [v is None for v in r] for r in got} == {r[0]: [v is None for v in r] for r in want}


def test_rates_count_values_at_a_level_like_the_checking_engine(spark, tmp_path):
    """A value of AFTER lies on the line between the two of BEFORE that the 5 % quantile is taken from."""
    x = [67.89, 30.61, 27.51, 49.6, 27.93, 229.11, 21.93, 110.06, 8.49, 23.85, 16.57, 35.99, 112.37, 60.41, 20.92, 136.77, 41.36, 31.52, 33.65, 13.14, 34.18, 1.97, 36.59, 22.65, 49.91, 17.21, 90.21, 66.66, 109.03, 23.54, 28.52, 32.44, 22.29, 59.0, 9.44, 136.28, 37.66, 21.77, 65.04, 13.64, 24.79, 1.64, 156.43, 26.02, 93.64, 0.37, 9.09, 45.78, 131.48, 10.6, 42.04, 51.46, 260.0, 11.28, 43.15, 38.14, 20.4, 46.43, 63.08, 83.68, 49.02, 13.21, 40.45, 10.91, 29.02, 15.26]
    assert not differs_from_its_sql(spark, tmp_path, "feat_rates", {1: x})


def test_exact_quantiles_of_short_empty_and_infinite_groups(spark):
    """Also where groups have no value, one value or values without bounds; 20,000 quantiles equal the checking engine's."""
    import duckdb
    import pandas as pd

    from driftline.operators.blocks import exact_quantiles

    rng = np.random.default_rng(4)
    rows = [(i, float(v)) for i in range(4000) for v in np.round(rng.normal(0, 10, rng.integers(1, 60)), 2) / 7.3]
    rows += [(4000, np.inf), (4000, 2.0), (4000, 3.0), (4001, -np.inf), (4001, 1.0), (4001, np.inf), (4002, 0.0), (4003, None)]
    qs = [0.05, 0.25, 0.5, 0.75, 0.95]
    spark.createDataFrame(rows, "id long, x double").createOrReplaceTempView("exact_src")
    got = spark.sql("WITH " + ", ".join(exact_quantiles("exact_src", "x", qs, "o")) + " SELECT id, q, y FROM o ORDER BY id, q").toPandas()
    given = pd.DataFrame(rows, columns=["id", "x"]).astype({"x": "Float64"})  # noqa: F841  read by name
    found = duckdb.sql("SELECT id, " + ", ".join(f"quantile_cont(x, {q})" for q in qs) + " FROM given GROUP BY id ORDER BY id").fetchall()
    np.testing.assert_array_equal(got.y.to_numpy(float), np.array([r[1:] for r in found], float).ravel())


def test_clipped_values_are_those_of_the_checking_engine_to_the_last_digit(spark, tmp_path):
    """Where each value stands six times, a bound lies between equal values, and constant windows of values at it have no spread but last digits."""
    import duckdb

    from driftline.functions.dialect import DUCKDB
    from driftline.operators.preprocess import preprocess_sql

    x = [120.98, 27.28, 44.83, 55.54, 6.31, 54.65, 19.76, 9.49, 85.87, 198.46, 9.27, 25.89, 66.03, 17.95, 5.38, 64.99, 81.65, 127.56, 66.61, 14.73, 5.11, 7.81, 28.07, 50.73, 120.25, 34.18, 70.16, 67.85, 116.74, 63.93, 69.55, 20.3, 37.17, 13.02, 26.31, 23.41, 28.38, 29.15, 29.18, 64.22, 80.95, 12.98, 48.96, 53.19, 25.74, 55.07, 37.64, 65.42, 0.96, 85.11, 12.02]
    y = [19.34, 6.09, 96.86, 32.88, 17.51, 83.0, 80.71, 185.97, 12.75, 21.5, 0.86, 20.4, 35.02, 19.11, 23.74, 36.95, 102.13, 132.25, 117.08, 25.78, 8.51, 134.83, 33.0, 0.38, 155.0, 42.57, 97.52, 11.85, 20.47, 53.65, 81.41, 6.84, 55.36, 78.27, 67.82, 96.66, 9.49, 10.63, 48.43, 138.69, 4.7, 1.92, 92.14, 2.07, 4.71, 85.22, 7.16, 74.13, 100.12, 25.64, 61.71]
    rows = [(i, 6 * k + c, v) for i, values in ((1, x), (2, y)) for k, v in enumerate(values) for c in range(6)] + [(90, 0, 1.5), (90, 1, 2.5), (91, 0, float("inf")), (91, 1, 3.0), (91, 2, 3.0), (91, 3, 1.0)]
    spark.createDataFrame(rows, "user_id long, event_id long, value double").selectExpr("user_id", "event_id", "timestamp_seconds(event_id) ts", "value").write.parquet(f"{tmp_path}/events.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        want = con.execute(f"WITH {preprocess_sql(E1, DUCKDB)} SELECT id, time, clipped FROM p ORDER BY id, time").df()
    got = build_preprocessed(spark, str(tmp_path), E1).select("id", "time", "clipped").orderBy("id", "time").toPandas()
    np.testing.assert_array_equal(got.to_numpy(float), want.to_numpy(float))
