"""All 185 features against formulas in numpy, written from their definitions and not from the SQL."""

import math

import numpy as np
import pytest

from driftline.operators.features import build_features
from driftline.sources.series import E1

EPS, BAND = 1e-9, 0.1
COARSE = [0.1, 0.25, 0.5, 0.75, 0.9]


def series(rng):
    """Values by id: noise, ties, shifts of level and spread, dependence, a trend, a wave; halves of 60 to 430 rows."""

    def walk(n, phi):
        x = np.zeros(n)
        for i in range(1, n):
            x[i] = phi * x[i - 1] + rng.normal()
        return x

    t = np.arange(860)
    return {
        1: rng.normal(5, 2, 120), 2: np.round(rng.normal(0, 2, 301)), 3: np.concatenate([rng.normal(0, 1, 250), rng.normal(3, 4, 250)]), 4: walk(433, 0.8) + 0.01 * np.arange(433),
        5: np.sin(t / 7) + rng.normal(0, 0.3, 860) * (1 + (t > 430)), 6: np.where(rng.random(400) < 0.1, 0.0, rng.standard_t(3, 400)), 7: np.concatenate([rng.normal(0, 1, 200), rng.normal(0, 1, 200) * 3 + 1]),
    }


def L(x):
    return math.log(max(x, EPS))


def ratio(a, b):
    return L((a + EPS) / (b + EPS))


def jeffreys(k, n):
    p = min(max((k + 0.5) / (n + 1), EPS), 1 - EPS)
    return math.log(p / (1 - p))


def atanh(x):
    return math.atanh(min(max(x, -1 + EPS), 1 - EPS))


def mad(x):
    return np.median(np.abs(x - np.median(x)))


def slope(x):
    return np.polyfit(np.arange(len(x)), x, 1)[0]


def crossings(x, level):
    """Where the series goes up, and where it goes down, through the band around the level."""
    low, high = x <= level - BAND, x >= level + BAND
    return np.flatnonzero(low[:-1] & high[1:]), np.flatnonzero(high[:-1] & low[1:])


def crossing_logit(x, level):
    return jeffreys(sum(map(len, crossings(x, level))), len(x) - 1)


def asymmetry(x, level):
    up, down = map(len, crossings(x, level))
    return (up - down) / (up + down + 1)


def acf(x, lags):
    c = x - x.mean()
    return [float((c[k:] * c[: len(c) - k]).sum() / ((len(c) - k) * c.var())) for k in range(1, lags + 1)]


def short(x, lags):
    return sum(abs(r) / k for k, r in enumerate(acf(x, lags), 1) if k > 1)


def box(x, m):
    n = len(x)
    return (n * (n + 2) * sum(r * r / (n - k) for k, r in enumerate(acf(x, m), 1)) - m) / math.sqrt(2 * m)


def power(x):
    n = len(x)
    k = np.arange(n // 2 + 1)
    c = (x - x.mean()) @ np.exp(-2j * np.pi * np.outer(np.arange(n), k) / n)
    return k / n, np.abs(c) ** 2 / n


def centroid(x):
    f, p = power(x)
    return (f * p).sum() / (p.sum() + EPS)


def quantile_distance(a, b, scale):
    return np.abs(np.quantile(a, COARSE) - np.quantile(b, COARSE)).mean() / max(scale, 1e-8)


def residuals(y):
    return np.square(y - np.polyval(np.polyfit(np.arange(len(y)), y, 1), np.arange(len(y)))).sum()


def expected(s, nb):
    """Every feature from the preprocessed series of one id."""
    b, a = ({k: v[:nb] for k, v in s.items()}, {k: v[nb:] for k, v in s.items()})
    out = {}
    each = lambda f, c: (f(b[c]), f(a[c]))

    def delta(name, f, c):
        before, after = each(f, c)
        out[name] = after - before

    def logratio(name, f, c):
        before, after = each(f, c)
        out[name] = ratio(after, before)

    z, w = "standardized", "detrended"
    # moments
    out["scaled_med_orig_b"] = np.median(b["original"]) / max(mad(b["original"]), EPS)
    out["mad_orig_b"] = L(mad(b["original"]))
    delta("med_delta", np.median, z)
    logratio("mad_logratio", mad, z)
    delta("mean_vs_med", lambda x: x.mean() - np.median(x), z)
    delta("std_vs_mad", lambda x: L(x.std() / (1.4826 * mad(x) + EPS)), z)
    moment = lambda x, k: ((x - x.mean()) ** k).mean() / x.std() ** k
    q = lambda x, p: np.quantile(x, p / 100)
    tilt = lambda x: L((q(x, 75) - q(x, 50)) / (q(x, 50) - q(x, 25) + EPS))
    out["skew_contrast"] = moment(a[z], 3) - tilt(a[z]) - moment(b[z], 3) - tilt(b[z])
    delta("kurt_contrast", lambda x: moment(x, 4) - 3 - L((q(x, 90) - q(x, 10)) / (q(x, 75) - q(x, 25) + EPS)), z)
    delta("slope_delta", slope, "clipped")
    # quantiles
    for p in (5, 10, 25, 40, 60, 75, 90, 95):
        delta(f"Q{p}_delta", lambda x, p=p: q(x, p), z)
    logratio("IDR_logratio", lambda x: q(x, 90) - q(x, 10), z)
    gap = lambda x, hi, lo: q(x, hi) - q(x, lo)
    for name, one, two in (("central_asym", (75, 50), (50, 25)), ("shoulder_asym", (90, 75), (25, 10)), ("tail_asym", (95, 90), (10, 5)), ("central_weight", (75, 25), (60, 40)), ("shoulder_weight", (90, 10), (75, 25)),
                           ("tail_weight", (95, 5), (90, 10)), ("central_decay", (75, 60), (60, 50)), ("shoulder_decay", (90, 75), (75, 60)), ("tail_decay", (95, 90), (90, 75))):
        delta(f"{name}_delta", lambda x, one=one, two=two: L(gap(x, *one) / (gap(x, *two) + EPS)), z)
    delta("moors_delta", lambda x: (gap(x, 90, 60) - gap(x, 40, 10)) / (gap(x, 75, 25) + EPS), z)
    top, bottom = lambda x: max(np.sort(x)[-5:].mean(), EPS), lambda x: max(-np.sort(x)[:5].mean(), EPS)
    delta("upper_ext_delta", lambda x: L(top(x) / (gap(x, 90, 10) + EPS)), z)
    delta("lower_ext_delta", lambda x: L(bottom(x) / (gap(x, 90, 10) + EPS)), z)
    delta("extreme_tail_asym_delta", lambda x: L(top(x) / bottom(x)), z)
    # rates
    q95, q5 = q(b[z], 95), q(b[z], 5)
    delta("abs_excd_q95_logit_delta", lambda x: jeffreys((abs(x) > q95).sum(), len(x)), z)
    delta("abs_excd_3_logit_delta", lambda x: jeffreys((abs(x) > 3).sum(), len(x)), z)
    delta("up_excd_q95_logit_delta", lambda x: jeffreys((x > q95).sum(), len(x)), z)
    delta("low_excd_q5_logit_delta", lambda x: jeffreys((x < q5).sum(), len(x)), z)

    def fano(x):
        hits = [(abs(x[i : i + 50]) > q95).sum() for i in range(0, len(x) - 49, 50)]
        return np.var(hits) / (np.mean(hits) + EPS) if hits and np.mean(hits) else 0.0

    logratio("fano_logratio", fano, z)
    for name, p in (("signflips", 50), ("CR25", 25), ("CR75", 75)):
        delta(f"{name}_logit_delta", lambda x, p=p: crossing_logit(x, q(b[z], p)), z)
    out["cr_decay_logit_delta"] = out["CR75_logit_delta"] - out["CR25_logit_delta"]
    delta("med_cross_asym_fisher_delta", lambda x: atanh(asymmetry(x, q(b[z], 50))), z)
    delta("pct_zeros_logit_delta", lambda x: jeffreys((abs(x) <= 1e-8).sum(), len(x)), "original")
    # autocorrelation of several series
    delta("acf1_delta", lambda x: acf(x, 1)[0], w)
    delta("acf2_delta", lambda x: acf(x, 2)[1], w)
    delta("pacf2_delta", lambda x: (acf(x, 2)[1] - acf(x, 1)[0] ** 2) / (1 - acf(x, 1)[0] ** 2), w)
    delta("shortlag_l1_delta", lambda x: short(x, 10), w)
    delta("lbq_stat_delta", lambda x: box(x, 20), w)
    delta("alt_signed_sum_delta", lambda x: sum((-1) ** (k - 1) * r for k, r in enumerate(acf(x, 10), 1)), w)
    for prefix in ("absval", "squared"):
        delta(f"{prefix}_acf1_delta", lambda x: acf(x, 1)[0], f"{prefix}_detrended")
        delta(f"{prefix}_shortlag_L1_delta", lambda x: short(x, 10), f"{prefix}_detrended")
        delta(f"{prefix}_lbq_stat_delta", lambda x: box(x, 20), f"{prefix}_detrended")
    # tests and distances
    n0, n1 = len(b[z]), len(a[z])
    pooled = (n0 * b[z].var() + n1 * a[z].var()) / (n0 + n1)
    out["gauss_glr_per_sample"] = ((n0 + n1) * math.log(pooled) - n0 * math.log(b[z].var()) - n1 * math.log(a[z].var())) / (n0 + n1)
    squares = np.cumsum(np.square(s[z]))
    out["css_norm"] = math.sqrt(n0 + n1) * np.abs(squares / squares[-1] - np.arange(1, n0 + n1 + 1) / (n0 + n1)).max()
    walk, most = [0, 0], 0.0
    for _, side in sorted([(v, 0) for v in b[z]] + [(v, 1) for v in a[z]]):
        walk[side] += 1
        most = max(most, abs(walk[0] / n0 - walk[1] / n1))
    r = math.sqrt(max(n0 * n1 / (n0 + n1), 1))
    out["ks_norm"] = (r + 0.12 + 0.11 / r) * most
    edges = np.unique(np.quantile(b[z], np.linspace(0, 1, 33)))
    share = [np.histogram(x, edges)[0] + 0.5 for x in (b[z], a[z])]
    share = [x / x.sum() for x in share]
    out["js_divergence"] = sum(0.5 * (x * np.log(x / (sum(share) / 2))).sum() for x in share)
    m = min(n0, n1, 512)
    width = max(gap(b[z], 75, 25), EPS) / 2
    x, y = (v[np.linspace(0, len(v) - 1, m).astype(int)] for v in (b[z], a[z]))
    k = lambda u, v: sum(math.exp(-((p - g) ** 2) / (2 * width**2)) for p in u for g in v)
    out["mmd2_rbf_idrband_equal"] = (k(x, x) + k(y, y)) / (m * (m - 1) + EPS) - 2 * k(x, y) / m**2

    def arch(v):
        e = (v - v.mean()) ** 2
        design = np.array([[1.0, *(e[i - j] for j in range(1, 6))] for i in range(5, len(e))])
        fit = design @ np.linalg.pinv(design) @ e[5:]
        stat = len(fit) * ((fit - e[5:].mean()) ** 2).sum() / (((e[5:] - e[5:].mean()) ** 2).sum() + EPS)
        grid = np.linspace(0, stat, 200_001)  # the chi-squared density with five degrees of freedom, summed up
        density = grid**1.5 * np.exp(-grid / 2) / (2**2.5 * math.gamma(2.5))
        return -math.log(max(1 - np.trapezoid(density, grid), EPS))

    delta("archlm_neglogp_delta", arch, z)
    # spectra, wavelets, patterns
    logratio_plain = lambda name, f, c: out.update({name: math.log((f(a[c]) + EPS) / (f(b[c]) + EPS))})
    flat = lambda x: math.exp(np.log(power(x)[1] + EPS).mean()) / (power(x)[1] + EPS).mean()
    logratio_plain("spec_flatness_logratio", flat, w)
    for i, (lo, hi) in enumerate([(0, 0.05), (0.05, 0.15), (0.15, 0.3), (0.3, 0.5)], 1):
        band = lambda x, lo=lo, hi=hi: power(x)[1][(power(x)[0] >= lo) & (power(x)[0] < hi)].sum() / (power(x)[1].sum() + EPS)
        logratio_plain(f"bandpower_b{i}_logratio", band, w)

    def level3(v):
        low = np.array([-0.12940952255126034, 0.2241438680420134, 0.8365163037378079, 0.48296291314453416])  # the published decomposition filters
        high, energies = np.array([-0.48296291314453416, 0.8365163037378079, -0.2241438680420134, -0.12940952255126034]), []
        for _ in range(3):
            wide = np.concatenate([v[2::-1], v, v[: -4 : -1]])
            take = lambda f, wide=wide, n=len(v): np.array([sum(f[j] * wide[i + 3 - j] for j in range(4)) for i in range(1, n + 3, 2)])
            v, d = take(low), take(high)
            energies.append((d**2).sum())
        return energies[2] / (sum(energies) + EPS)

    out["dwt_l3_energy_logratio"] = (math.log((level3(a[w]) + EPS) / (level3(b[w]) + EPS)))

    def patterns(v, m):
        found = {}
        for i in range(len(v) - m + 1):
            key = tuple(sorted(range(m), key=lambda j: (v[i + j], j)))
            found[key] = found.get(key, 0) + 1
        p = np.array(list(found.values())) / (len(v) - m + 1)
        return -(p * np.log(p + EPS)).sum() / (math.log(math.factorial(m)) + EPS)

    for m in (3, 5):
        delta(f"perm_entropy_m{m}_delta", lambda x, m=m: patterns(x, m), z)
    # differences
    d = "diff_standardized"
    delta("diff_abs_excd_3_logit_delta", lambda x: jeffreys((abs(x) > 3).sum(), len(x)), d)
    delta("diff_up_excd_q95_logit_delta", lambda x: jeffreys((x > q(b[d], 95)).sum(), len(x)), d)
    delta("diff_low_excd_q5_logit_delta", lambda x: jeffreys((x < q(b[d], 5)).sum(), len(x)), d)
    delta("diff_signflips_logit_delta", lambda x: crossing_logit(x, 0.0), d)
    delta("diff_shortlag_l1_delta", lambda x: short(x, 10), "diff_detrended")
    delta("diff_lbq_stat_delta", lambda x: box(x, 20), "diff_detrended")
    delta("diff_spec_centroid_delta", centroid, "diff_detrended")
    delta("absdiff_acf1_delta", lambda x: acf(x, 1)[0], "absdiff_detrended")
    # boundary, local
    for width in (32, 128):
        lb, la = ({k: v[-width:] for k, v in b.items()}, {k: v[:width] for k, v in a.items()})
        local = lambda name, f, c: out.update({f"local_{name}_w{width}": f(la[c]) - f(lb[c])})  # noqa: E731, B023
        local("median_jump", np.median, z)
        local("MAD_logratio", lambda x: math.log(1.4826 * mad(x) + EPS), z)
        local("slope_jump", slope, w)
        local("IDR_logratio", lambda x: math.log(gap(x, 90, 10) + EPS), z)
        local("abs_excd_q95_logit_delta", lambda x: jeffreys((abs(x) > q95).sum(), len(x)), z)
        local("abs_excd_3_logit_delta", lambda x: jeffreys((abs(x) > 3).sum(), len(x)), z)
        local("signflips_logit_delta", lambda x: crossing_logit(x, 0.0), z)
        local("med_cross_asym_fisher_delta", lambda x: atanh(asymmetry(x, 0.0)), z)

        def residence(x):
            at = np.sort(np.concatenate(crossings(x, 0.0)))
            return 0.0 if not len(at) else L((len(x) - 1) / 2 + EPS) if len(at) == 1 else L((at[-1] - at[0]) / (len(at) - 1) + EPS)

        local("res_time_logratio", residence, z)
        local("acf1_delta", lambda x: acf(x, 1)[0], w)
        local("shortlag_L1_delta", lambda x: short(x, 6), w)
        local("spec_centroid_delta", centroid, w)
        local("diff_median_jump", np.median, d)
        local("dd_MAD_logratio", lambda x: math.log(1.4826 * mad(x) + EPS), "diff2_standardized")
        local("dd_acf1_delta", lambda x: acf(x, 1)[0], "diff2_detrended")
        rms = lambda x: math.sqrt((x**2).mean())
        out[f"local_rms_logratio_w{width}"] = math.log(rms(la[w]) + EPS) - math.log(rms(lb[w]) + EPS)
        out[f"local_w1_scaled_w{width}"] = quantile_distance(la[z], lb[z], max(gap(lb[z], 75, 25), EPS))
        dd = "diff2_standardized"
        out[f"local_dd_w1_scaled_w{width}"] = quantile_distance(la[dd], lb[dd], gap(lb[dd], 90, 10) + EPS)
        greater = np.sign(la[z][:, None] - lb[z][None, :]).mean()
        out[f"local_cliffs_fisher_delta_w{width}"] = atanh(greater)
        one, two = lb["clipped"], la["clipped"]
        apart, together = residuals(one) + residuals(two), residuals(np.concatenate([one, two]))
        out[f"local_chow_F_w{width}"] = max((together - apart) / 2 / (apart / (len(one) + len(two) - 4)), 0.0)
        both = np.concatenate([lb[w], la[w]])
        out[f"local_cusum_signed_w{width}"] = (la[w] - both.mean()).sum() / ((both.std() + EPS) * math.sqrt(len(both)))
        both = np.concatenate([lb[z], la[z]])
        part = lambda x: len(x) * math.log(max(x.var(), EPS))
        out[f"local_gauss_glr_w{width}"] = part(both) - part(lb[z]) - part(la[z])
    # boundary, edges
    middle = np.median(b[z][-5:])

    def rank(v):
        p = ((b[z] < v).sum() + 0.5 * (b[z] == v).sum() + 0.5) / (n0 + 1)
        p = min(max(p, EPS), 1 - EPS)
        return math.log(p / (1 - p))

    steps, ranks = [], []
    for off in (0, 8, 16, 32):
        v = np.median(a[z][min(off, n1 - 1) :][:5])
        steps.append(v - middle)
        ranks.append(rank(v) - rank(middle))
        out[f"edge_dz_o{off}"], out[f"edge_ranklogit_delta_o{off}"] = steps[-1], ranks[-1]
    out["edge_dz_max_abs"], out["edge_ranklogit_max_abs"] = max(steps, key=abs), max(ranks, key=abs)
    # curvature
    dd = "diff2_standardized"
    square = lambda x: (x**2).mean()
    delta("curv_energy_logratio", lambda x: math.log(square(x) + EPS), dd)
    out["curv_vs_slope_logratio"] = math.log(square(a[dd]) / (square(a[d]) + EPS) + EPS) - math.log(square(b[dd]) / (square(b[d]) + EPS) + EPS)
    delta("dd_posrate_logit_delta", lambda x: jeffreys((x > 0).sum(), len(x)), dd)
    delta("dd_acf1_delta", lambda x: acf(x, 1)[0], "diff2_detrended")
    delta("dd_shortlag_L1_delta", lambda x: short(x, 10), "diff2_detrended")
    delta("dd_lbq_z_delta", lambda x: box(x, min(20, n0 - 1, n1 - 1)), "diff2_detrended")
    delta("dd_spec_centroid_delta", centroid, "diff2_detrended")
    # rolling windows
    for width in (10, 20, 50, 100, 200):
        enough = min(n0, n1) - 2 * width + 1 >= 20
        spread = lambda x, width=width: [math.log(x[i : i + width].std() + EPS) for i in range(len(x) - width + 1)]
        root = lambda x, width=width: [math.log(rms(x[i : i + width]) + EPS) for i in range(len(x) - width + 1)]

        def rate(x, width=width):
            p = [(sum(map(len, crossings(x[i : i + width], 0.0))) + 0.5) / width for i in range(len(x) - width + 1)]
            return [math.log(v / (1 - v)) for v in np.clip(p, EPS, 1 - EPS)]

        for name, f, c in (("roll_logstd_jump", spread, "clipped"), ("roll_rms_jump", root, "diff_detrended"), ("roll_crossrate_logit", rate, "clipped")):
            jumps = [np.array(v[width:]) - np.array(v[:-width]) for v in map(np.array, each(f, c))] if enough else [np.zeros(1)] * 2
            for how, g in (("maxpos", np.max), ("maxneg", np.min), ("topkabs_mean", lambda j: np.sort(np.abs(j))[-3:].mean())):
                out[f"{name}_w{width}_{how}_delta"] = g(jumps[1]) - g(jumps[0])
    for life in (200, 400):

        def last(x, keep=2 ** (-1 / life)):
            v = x[0] ** 2
            for u in x[1:]:
                v = keep * v + (1 - keep) * u**2
            return v

        logratio(f"ewvar_hl{life}_logratio", last, "clipped")
    # regression on the value before
    h = min(256, n0 // 2, n1)
    fit = b[w][: n0 - h]
    u, v = fit[:-1], fit[1:]
    phi = ((u - u.mean()) * (v - v.mean())).sum() / (((u - u.mean()) ** 2).sum() + 1.0)
    c = v.mean() - phi * u.mean()
    s2 = ((v - c - phi * u) ** 2).mean() + EPS
    nll = lambda y: 0.5 * (math.log(2 * math.pi * s2) + ((y[1:] - c - phi * y[:-1]) ** 2).mean() / s2)
    top, bottom = nll(a[w][:h]) + EPS, nll(b[w][-h:]) + EPS
    out["ar_ridge_nll_logratio"] = math.log(top / bottom) if top / bottom > 0 else None
    return out


def test_every_feature(spark, tmp_path):
    values = series(np.random.default_rng(12))
    rows = [(i, k, float(v)) for i, x in values.items() for k, v in enumerate(x)]
    spark.createDataFrame(rows, "user_id long, event_id long, value double").selectExpr("user_id", "event_id", "timestamp_seconds(event_id) ts", "value").write.parquet(f"{tmp_path}/events.parquet")
    from test_features import prep

    found = {r.id: r.asDict() for r in build_features(spark, str(tmp_path), E1).collect()}
    for i, x in values.items():
        nb, s = prep(x)
        want = expected(s, nb)
        assert set(want) == set(found[i]) - {"id"} and len(want) == 185
        wrong = {c: (found[i][c], w) for c, w in want.items() if found[i][c] != w and found[i][c] != pytest.approx(w, abs=2e-5, rel=1e-5)}
        assert not wrong, (i, len(wrong), wrong)
