"""Numeric kernels that SQL does not express well: spectra of long series, wavelets, regressions, kernel distances.

They run per id in one grouped pass (applyInPandas), which gives all their columns at once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS, ARCH_LAGS, MMD_CAP = 1e-9, 5, 512
COLUMNS = ["archlm_neglogp_delta", "dwt_l3_energy_logratio", "mmd2_rbf_idrband_equal"]


def gamma_upper(a: float, x: float) -> float:
    """The upper regularised incomplete gamma function: below a + 1 by the series of the lower one, beyond by a continued fraction."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - scale * total)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    fraction = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or 1e-300)
        c = b + step / c or 1e-300
        fraction *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * fraction


def arch_lm(z: np.ndarray, lags: int = ARCH_LAGS) -> float:
    """n R^2 of the squared deviations on their own lags; 0 where the segment is too short."""
    if len(z) <= lags + 1:
        return 0.0
    e = np.square(z - z.mean())
    y, x = e[lags:], np.column_stack([np.ones(len(e) - lags), *(e[lags - j : len(e) - j] for j in range(1, lags + 1))])
    fit = x @ np.linalg.lstsq(x, y, rcond=None)[0]
    return float(len(y) * np.square(fit - y.mean()).sum() / (np.square(y - y.mean()).sum() + EPS))


def arch_neglogp(z: np.ndarray) -> float:
    return -math.log(max(gamma_upper(ARCH_LAGS / 2, arch_lm(z) / 2), EPS))


_ROOT = math.sqrt(3)
#: Daubechies' filter of two vanishing moments, for decomposition; the high pass alternates signs.
LOW = np.array([1 - _ROOT, 3 - _ROOT, 3 + _ROOT, 1 + _ROOT]) / (4 * math.sqrt(2))
HIGH = np.array([-(1 + _ROOT), 3 + _ROOT, -(3 - _ROOT), 1 - _ROOT]) / (4 * math.sqrt(2))


def dwt(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Approximation and detail, with half-sample symmetric ends; every second sample of the full filter response."""
    reach = len(LOW) - 1
    at = np.arange(-reach, len(x) + reach) % (2 * len(x))
    wide = x[np.where(at < len(x), at, 2 * len(x) - 1 - at)]
    return tuple(np.convolve(wide, f, "valid")[1::2] for f in (LOW, HIGH))


def level3_share(x: np.ndarray) -> float:
    """Share of the third level in the energy of the details of three levels."""
    energies = []
    for _ in range(3):
        x, detail = dwt(x)
        energies.append(float(np.square(detail).sum()))
    return energies[2] / (sum(energies) + EPS)


def even_places(n: int, m: int) -> np.ndarray:
    """m places from 0 to n - 1, truncated; the last is n - 1."""
    return np.linspace(0, n - 1, m, dtype=int)


def mmd2(before: np.ndarray, after: np.ndarray, cap: int = MMD_CAP) -> float:
    """Squared kernel distance of equally long subsamples. The diagonal ones stay in the sums, as in the published features."""
    m = min(len(before), len(after), cap)
    if m < 2:
        return 0.0
    width = max(np.quantile(before, 0.75) - np.quantile(before, 0.25), EPS) / 2
    b, a = before[even_places(len(before), m)], after[even_places(len(after), m)]
    kernel = lambda x, y: np.exp(-np.square(x[:, None] - y[None, :]) / (2 * width * width))
    return float((kernel(b, b).sum() + kernel(a, a).sum()) / (m * (m - 1) + EPS) - 2 * kernel(b, a).mean())


def spectrum(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and power of the centred series, without a window."""
    return np.arange(len(x) // 2 + 1) / len(x), np.square(np.abs(np.fft.rfft(x - x.mean()))) / len(x)


#: Series whose spectra blocks read.
TRANSFORMED = ["detrended", "diff_detrended", "diff2_detrended"]


def spectra(p: DataFrame) -> DataFrame:
    """id, period, series, n, k, f, power of the series of a preprocessed table, by one pass of fast Fourier transforms."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, out = rows.sort_values("t"), []
        for period in (0, 1):
            half = rows[rows.period == period]
            for series in TRANSFORMED:
                f, power = spectrum(half[series].to_numpy())
                out.append(pd.DataFrame({"id": key[0], "period": period, "series": series, "n": len(half), "k": np.arange(len(f)), "f": f, "power": power}))
        return pd.concat(out)

    found = p.select("id", "period", "t", *TRANSFORMED).groupBy("id").applyInPandas(one, "id long, period int, series string, n long, k long, f double, power double")
    # The power of a series without bounds is NaN, which pandas hands over as null; aggregates would leave it out.
    return found.withColumn("power", F.coalesce("power", F.lit(math.nan)))


def kernel_columns(p: DataFrame) -> DataFrame:
    """id and COLUMNS for every id of a preprocessed table."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        b, a = rows[rows.period == 0], rows[rows.period == 1]
        zb, za = b.standardized.to_numpy(), a.standardized.to_numpy()
        energy = [level3_share(x.detrended.to_numpy()) for x in (b, a)]
        return pd.DataFrame([[key[0], arch_neglogp(za) - arch_neglogp(zb), math.log((energy[1] + EPS) / (energy[0] + EPS)), mmd2(zb, za)]], columns=["id", *COLUMNS])

    return p.select("id", "period", "t", "standardized", "detrended").groupBy("id").applyInPandas(one, "id long, " + ", ".join(f"{c} double" for c in COLUMNS))


def mmd_sql() -> list[str]:
    """CTEs that end in mq (id, mmd): the same distance by a join within the id, for checking on short series."""
    place = lambda n: f"CASE WHEN i = m - 1 THEN {n} - 1 ELSE CAST(floor(i * (({n} - 1e0) / (m - 1))) AS BIGINT) END"
    k = "exp(-power(x.v - y.v, 2e0) / (2e0 * w * w))"
    return [
        f"ma AS (SELECT id, max(CASE WHEN period = 0 THEN n END) AS n0, max(CASE WHEN period = 1 THEN n END) AS n1, least({MMD_CAP}, min(n)) AS m FROM p GROUP BY id)",
        "mb AS (SELECT id, greatest(quantile_cont(standardized, 0.75) - quantile_cont(standardized, 0.25), 1e-9) / 2e0 AS w FROM p WHERE period = 0 GROUP BY id)",
        "mc AS (SELECT id, n0, n1, m, unnest(range(0, m)) AS i FROM ma)",
        f"md AS (SELECT mc.id, m, p.period, p.standardized AS v FROM mc JOIN p ON mc.id = p.id AND p.t = CASE WHEN p.period = 0 THEN {place('n0')} ELSE {place('n1')} END)",
        f"me AS (SELECT x.id, max(x.m) AS m, sum(CASE WHEN x.period = y.period THEN {k} END) AS same, sum(CASE WHEN x.period = 0 AND y.period = 1 THEN {k} END) AS other FROM md x JOIN md y ON x.id = y.id JOIN mb ON x.id = mb.id GROUP BY x.id)",
        "mq AS (SELECT id, same / (m * (m - 1e0) + 1e-9) - 2e0 * other / (m * 1e0 * m) AS mmd FROM me)",
    ]
