"""Feature blocks as SQL. A block is (CTEs after p, last CTE, its columns); it gives one row per id.

Kernels take the CTE they read (src, with id, period, t, n and the series) and give CTEs whose
names start with `out`. AFTER minus BEFORE is delta(); windows are rows, never ranges.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from driftline.functions.dialect import EPS, Dialect, after, before, delta, fisher, jeffreys, log, log_ratio, rounded
from driftline.operators.preprocess import preprocess_sql
from driftline.sources.series import Adapter

COARSE = [0.1, 0.25, 0.5, 0.75, 0.9]
FINE = [0.05, 0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9, 0.95]
TOP_K, FANO_BLOCK, DEADBAND = 5, 50, "0.1e0"
ACF_LAGS, LBQ_LAGS, LOCAL_LAGS, JS_EDGES = 10, 20, 6, 33
LOCAL_WINDOWS, EDGE, EDGE_OFFSETS = (32, 128), 5, (0, 8, 16, 32)
ROLL_WINDOWS, ROLL_LEAST, ROLL_TOP, HALF_LIVES = (10, 20, 50, 100, 200), 20, 3, (200, 400)
AR_CAP, AR_RIDGE = 256, "1e0"
W = "OVER (PARTITION BY id, period ORDER BY t)"


@dataclass(frozen=True)
class Block:
    ctes: list[str]
    source: str
    columns: dict[str, str]
    grouped: bool = True

    def _select(self) -> str:
        return f"SELECT id, {rounded(self.columns)} FROM {self.source}" + (" GROUP BY id" if self.grouped else "")

    def over_p(self) -> str:
        """The statement over a table p."""
        return "WITH " + ",\n".join(self.ctes) + "\n" + self._select()

    def sql(self, adapter: Adapter, d: Dialect) -> str:
        """The statement over the tables that the adapter reads."""
        return f"WITH {preprocess_sql(adapter, d)},\n" + ",\n".join(self.ctes) + "\n" + self._select()


# kernels


def acf(src: str, x: str, lags: int, out: str) -> list[str]:
    """out: id, period, n, v and r1..: autocorrelations, 0 for a constant segment, null from lag n on."""
    every = range(1, lags + 1)
    return [
        f"{out}_a AS (SELECT id, period, t, n, {x} - avg({x}) OVER (PARTITION BY id, period) AS c FROM {src})",
        f"{out}_b AS (SELECT id, period, n, c, " + ", ".join(f"lag(c, {k}) {W} AS l{k}" for k in every) + f" FROM {out}_a)",
        f"{out}_c AS (SELECT id, period, max(n) AS n, avg(c * c) AS v, " + ", ".join(f"sum(c * l{k}) AS s{k}" for k in every) + f" FROM {out}_b GROUP BY id, period)",
        f"{out} AS (SELECT id, period, n, v, " + ", ".join(f"CASE WHEN v <= 0 THEN 0e0 WHEN n > {k} THEN s{k} / ((n - {k}) * v) END AS r{k}" for k in every) + f" FROM {out}_c)",
    ]


def shortlag(lags: int) -> str:
    return "(" + " + ".join(f"coalesce(abs(r{k}), 0e0) / {k}" for k in range(2, lags + 1)) + ")"


def ljung_box(lags: int) -> str:
    """Standardised; 0 where the segment is no longer than the lags."""
    q = " + ".join(f"r{k} * r{k} / greatest(n - {k}, 1)" for k in range(1, lags + 1))
    return f"(CASE WHEN n > {lags} THEN (n * (n + 2e0) * ({q}) - {lags}) / sqrt(2e0 * {lags}) ELSE 0e0 END)"


def mads(src: str, columns: list[str], out: str) -> list[str]:
    """out: id, period, med_x and mad_x of each column."""
    return [
        f"{out}_m AS (SELECT id, period, " + ", ".join(f"median({c}) AS med_{c}" for c in columns) + f" FROM {src} GROUP BY id, period)",
        f"{out} AS (SELECT s.id, s.period, " + ", ".join(f"max(med_{c}) AS med_{c}, median(abs(s.{c} - med_{c})) AS mad_{c}" for c in columns)
        + f" FROM {src} s JOIN {out}_m m ON s.id = m.id AND s.period = m.period GROUP BY s.id, s.period)",
    ]


def crossings(x: str, following: str, level: str) -> tuple[str, str]:
    """Predicates up and down across a level with the deadband."""
    low, high = f"{level} - {DEADBAND}", f"{level} + {DEADBAND}"
    return f"({x} <= {low} AND {following} >= {high})", f"({x} >= {high} AND {following} <= {low})"


def count(predicate: str) -> str:
    return f"sum(CASE WHEN {predicate} THEN 1 ELSE 0 END)"


def slope(x: str) -> str:
    """Least squares slope over t, 0 for a single row."""
    middle = "(t - (n - 1) / 2e0)"
    return f"(sum({x} * {middle}) / max(greatest((n * 1e0 * n - 1) * n / 12e0, {EPS})))"


def exact_quantiles(src: str, x: str, qs: list[float], out: str) -> list[str]:
    """For Spark. out: id, q and y, the quantile of x with the last digit that the checking engine gives it, for values that are compared with it.

    At step i + f of the sorted values v that is fma(v[i], 1 - f, v[i + 1] * f): the first product is not rounded, as it is in percentile.
    Here product and sum are taken apart into what doubles hold and the rest (Dekker, Knuth), and the rests are added last.
    """
    half = lambda c: f"134217729e0 * {c} - (134217729e0 * {c} - {c})"  # noqa: E731  its upper 26 bits: products of halves are exact
    return [
        f"{out}_v AS (SELECT id, sort_array(collect_list({x})) AS v FROM {src} GROUP BY id)",
        f"{out}_i AS (SELECT id, v, q, (size(v) - 1) * q AS i FROM {out}_v LATERAL VIEW explode(array({', '.join(f'{q}e0' for q in qs)})) qs_ AS q)",
        f"{out}_f AS (SELECT id, q, get(v, CAST(floor(i) AS INT)) AS low, get(v, CAST(ceil(i) AS INT)) AS high, i - floor(i) AS f, 1e0 - (i - floor(i)) AS g FROM {out}_i)",
        f"{out}_c AS (SELECT id, q, low, f, g, low * g AS c, high * f AS d, {half('low')} AS a, {half('g')} AS b FROM {out}_f)",
        f"{out}_s AS (SELECT id, q, low, f, c, d, c + d AS s, a * b - c + a * (g - b) + (low - a) * b + (low - a) * (g - b) AS rest FROM {out}_c)",
        f"{out} AS (SELECT id, q, CASE WHEN f = 0e0 THEN low WHEN abs(low) < 1e290 AND abs(s) < 1e290 THEN s + ((c - (s - (s - c))) + (d - (s - c)) + rest) ELSE s END AS y FROM {out}_s)",
    ]


def psd_join(src: str, x: str, out: str, d: Dialect) -> list[str]:
    """out: id, period, n, k, f, p: the power at each of n / 2 + 1 frequencies. Whole series come from the stored table of fast transforms (spectra), short windows and the checking engine by sums over rows."""
    if d.name == "spark" and src == "p":
        return [f"{out} AS (SELECT id, period, n, k, f, power AS p FROM spectra WHERE series = '{x}')"]
    return [
        f"{out}_a AS (SELECT id, period, t, n, {x} - avg({x}) OVER (PARTITION BY id, period) AS c FROM {src})",
        f"{out}_b AS (SELECT id, period, t, n, c, k FROM {d.numbers(f'{out}_a', d.div('n', '2'), 'k')})",
        f"{out} AS (SELECT id, period, max(n) AS n, k, k * 1e0 / max(n) AS f, (power(sum(c * cos(2e0 * pi() * k * t / n)), 2e0) + power(sum(c * sin(2e0 * pi() * k * t / n)), 2e0)) / max(n) AS p FROM {out}_b GROUP BY id, period, k)",
    ]


def centroid(src: str, out: str) -> str:
    return f"{out} AS (SELECT id, period, CASE WHEN sum(p) <= 0 THEN 0e0 ELSE sum(f * p) / (sum(p) + {EPS}) END AS centroid FROM {src} GROUP BY id, period)"


# blocks


def moments(d: Dialect) -> Block:
    z = "standardized"
    return Block(
        [
            *mads("p", ["original", z], "mm"),
            f"ms AS (SELECT id, period, avg({z}) AS mean, stddev_pop({z}) AS sd, {slope('clipped')} AS slope, "
            + ", ".join(f"{d.quantile(z, q)} AS q{int(q * 100)}" for q in COARSE) + " FROM p GROUP BY id, period)",
            f"mk AS (SELECT p.id, p.period, avg(power({z} - mean, 3e0)) AS c3, avg(power({z} - mean, 4e0)) AS c4 FROM p JOIN ms ON p.id = ms.id AND p.period = ms.period GROUP BY p.id, p.period)",
            f"mo AS (SELECT mm.id, mm.period, med_original, mad_original, med_{z}, mad_{z}, mean, sd, slope, "
            f"CASE WHEN sd > 0 THEN c3 / power(sd, 3e0) END - {log(f'(q75 - q50) / (q50 - q25 + {EPS})')} AS skew_less, "
            f"CASE WHEN sd > 0 THEN c3 / power(sd, 3e0) END + {log(f'(q75 - q50) / (q50 - q25 + {EPS})')} AS skew_more, "
            f"CASE WHEN sd > 0 THEN c4 / power(sd, 4e0) - 3e0 END - {log(f'(q90 - q10) / (q75 - q25 + {EPS})')} AS kurt "
            "FROM mm JOIN ms ON mm.id = ms.id AND mm.period = ms.period JOIN mk ON mm.id = mk.id AND mm.period = mk.period)",
        ],
        "mo",
        {
            "scaled_med_orig_b": before(f"med_original / greatest(mad_original, {EPS})"),
            "med_delta": delta(f"med_{z}"),
            "mad_orig_b": before(log("mad_original")),
            "mad_logratio": log_ratio(after(f"mad_{z}"), before(f"mad_{z}")),
            "mean_vs_med": delta(f"(mean - med_{z})"),
            "std_vs_mad": delta(log(f"sd / (1.4826e0 * mad_{z} + {EPS})")),
            # The BEFORE term enters with the sign that the published features have.
            "skew_contrast": f"{after('skew_less')} - {before('skew_more')}",
            "kurt_contrast": delta("kurt"),
            "slope_delta": delta("slope"),
        },
    )


def quantiles(d: Dialect) -> Block:
    z = "standardized"
    ranks = f"qr AS (SELECT id, period, {z}, row_number() OVER (PARTITION BY id, period ORDER BY {z}) AS up, row_number() OVER (PARTITION BY id, period ORDER BY {z} DESC) AS down FROM p)"
    q = ", ".join(f"{d.quantile(z, x)} AS q{round(x * 100)}" for x in FINE)
    ends = f"avg(CASE WHEN down <= {TOP_K} THEN {z} END) AS top, avg(CASE WHEN up <= {TOP_K} THEN {z} END) AS bottom"
    iqr, idr = "(q75 - q25)", "(q90 - q10)"
    ratio = lambda a, b: log(f"({a}) / ({b} + {EPS})")
    columns = {f"Q{x}_delta": delta(f"q{x}") for x in (5, 10, 25, 40, 60, 75, 90, 95)}
    columns["IDR_logratio"] = log_ratio(after(idr), before(idr))
    shapes = {
        "central_asym": ratio("q75 - q50", "q50 - q25"), "shoulder_asym": ratio("q90 - q75", "q25 - q10"), "tail_asym": ratio("q95 - q90", "q10 - q5"),
        "central_weight": ratio(iqr, "q60 - q40"), "shoulder_weight": ratio(idr, iqr), "tail_weight": ratio("q95 - q5", idr),
        "moors": f"((q90 - q60) - (q40 - q10)) / ({iqr} + {EPS})",
        "central_decay": ratio("q75 - q60", "q60 - q50"), "shoulder_decay": ratio("q90 - q75", "q75 - q60"), "tail_decay": ratio("q95 - q90", "q90 - q75"),
        "upper_ext": ratio(f"greatest(top, {EPS})", idr), "lower_ext": ratio(f"greatest(-bottom, {EPS})", idr),
        "extreme_tail_asym": log(f"greatest(top, {EPS}) / greatest(-bottom, {EPS})"),
    }
    columns |= {f"{k}_delta": delta(f"({v})") for k, v in shapes.items()}
    return Block([ranks, f"qq AS (SELECT id, period, {q}, {ends} FROM qr GROUP BY id, period)"], "qq", columns)


def _levels(d: Dialect, x: str, out: str) -> list[str]:
    """out: id and BEFORE quantiles b5..b95 of x. Values are counted beyond them, so their last digit matters."""
    qs = [0.05, 0.25, 0.5, 0.75, 0.95]
    if d.name == "spark":
        found = ", ".join(f"max(CASE WHEN q = {q}e0 THEN y END) AS b{round(q * 100)}" for q in qs)
        return [f"{out}_b AS (SELECT id, {x} FROM p WHERE period = 0)", *exact_quantiles(f"{out}_b", x, qs, f"{out}_q"), f"{out} AS (SELECT id, {found} FROM {out}_q GROUP BY id)"]
    return [f"{out} AS (SELECT id, " + ", ".join(f"{d.quantile(x, q)} AS b{round(q * 100)}" for q in qs) + " FROM p WHERE period = 0 GROUP BY id)"]


def rates(d: Dialect) -> Block:
    z = "z"
    parts = []
    for level in (25, 50, 75):
        up, down = crossings(z, "following", f"b{level}")
        parts += [f"{count(up)} AS up{level}", f"{count(down)} AS down{level}"]
    fano = [
        f"rf AS (SELECT p.id, period, {d.div('t', str(FANO_BLOCK))} AS block, {count('abs(standardized) > b95')} * 1e0 AS hits FROM p JOIN rb ON p.id = rb.id "
        f"WHERE t < {d.div('n', str(FANO_BLOCK))} * {FANO_BLOCK} GROUP BY p.id, period, {d.div('t', str(FANO_BLOCK))})",
        f"rg AS (SELECT id, period, CASE WHEN avg(hits) > 0 THEN var_pop(hits) / (avg(hits) + {EPS}) ELSE 0e0 END AS fano FROM rf GROUP BY id, period)",
    ]
    asym = "CASE WHEN up50 + down50 = 0 THEN 0e0 ELSE (up50 - down50) * 1e0 / (up50 + down50 + 1) END"
    total = lambda k: jeffreys(f"up{k} + down{k}", "n - 1")
    return Block(
        [
            *_levels(d, "standardized", "rb"),
            f"ra AS (SELECT id, period, n, standardized AS z, original, lead(standardized) {W} AS following FROM p)",
            f"rc AS (SELECT ra.id, period, max(n) AS n, {count('abs(z) > b95')} AS far, {count('abs(z) > 3e0')} AS far3, {count('z > b95')} AS above, {count('z < b5')} AS below, "
            f"{count('abs(original) <= 1e-8')} AS zeros, {', '.join(parts)} FROM ra JOIN rb ON ra.id = rb.id GROUP BY ra.id, period)",
            *fano,
            "rt AS (SELECT rc.*, coalesce(fano, 0e0) AS fano FROM rc LEFT JOIN rg ON rc.id = rg.id AND rc.period = rg.period)",
        ],
        "rt",
        {
            "abs_excd_q95_logit_delta": delta(jeffreys("far", "n")), "abs_excd_3_logit_delta": delta(jeffreys("far3", "n")),
            "up_excd_q95_logit_delta": delta(jeffreys("above", "n")), "low_excd_q5_logit_delta": delta(jeffreys("below", "n")),
            "fano_logratio": log_ratio(after("fano"), before("fano")),
            "signflips_logit_delta": delta(total(50)), "CR25_logit_delta": delta(total(25)), "CR75_logit_delta": delta(total(75)),
            "med_cross_asym_fisher_delta": delta(fisher(f"({asym})")),
            "cr_decay_logit_delta": delta(f"(({total(75)}) - ({total(25)}))"),
            "pct_zeros_logit_delta": delta(jeffreys("zeros", "n")),
        },
    )


def autocorr(d: Dialect) -> Block:
    alternating = " ".join(f"{'+' if k % 2 else '-'} coalesce(r{k}, 0e0)" for k in range(1, ACF_LAGS + 1))
    pacf2 = f"((r2 - r1 * r1) / CASE WHEN 1e0 - r1 * r1 <= 0 THEN {EPS} ELSE 1e0 - r1 * r1 END)"
    return Block(acf("p", "detrended", LBQ_LAGS, "ac"), "ac", {
        "acf1_delta": delta("r1"), "acf2_delta": delta("r2"), "pacf2_delta": delta(pacf2), "shortlag_l1_delta": delta(shortlag(ACF_LAGS)),
        "lbq_stat_delta": delta(ljung_box(LBQ_LAGS)), "alt_signed_sum_delta": delta(f"(0e0 {alternating})"),
    })


def _memory(series: str, prefix: str) -> Callable[[Dialect], Block]:
    def block(d: Dialect) -> Block:
        return Block(acf("p", series, LBQ_LAGS, "ac"), "ac", {
            f"{prefix}_acf1_delta": delta("r1"), f"{prefix}_shortlag_L1_delta": delta(shortlag(ACF_LAGS)), f"{prefix}_lbq_stat_delta": delta(ljung_box(LBQ_LAGS)),
        })

    return block


absolute, squared = _memory("absval_detrended", "absval"), _memory("squared_detrended", "squared")


def glr_css(d: Dialect) -> Block:
    v = "standardized"
    return Block(
        [
            f"gv AS (SELECT id, period, count(*) AS m, greatest(var_pop({v}), {EPS}) AS s2 FROM p GROUP BY id, period)",
            f"gg AS (SELECT id, {before('m')} AS n0, {after('m')} AS n1, {before('s2')} AS s0, {after('s2')} AS s1 FROM gv GROUP BY id)",
            f"gc AS (SELECT id, sum({v} * {v}) OVER (PARTITION BY id ORDER BY time ROWS UNBOUNDED PRECEDING) AS upto, sum({v} * {v}) OVER (PARTITION BY id) AS total, time + 1 AS k, count(*) OVER (PARTITION BY id) AS n FROM p)",
            "gx AS (SELECT id, CASE WHEN max(total) > 0 THEN sqrt(max(n) * 1e0) * max(CASE WHEN total > 0 THEN abs(upto / total - k * 1e0 / n) END) ELSE 0e0 END AS css FROM gc GROUP BY id)",
            "gt AS (SELECT gg.id, n0, n1, s0, s1, (n0 * s0 + n1 * s1) / (n0 + n1) AS sp, css FROM gg JOIN gx ON gg.id = gx.id)",
        ],
        "gt",
        {"gauss_glr_per_sample": "((n0 + n1) * ln(sp) - n0 * ln(s0) - n1 * ln(s1)) / (n0 + n1)", "css_norm": "css"},
        grouped=False,
    )


def ks(d: Dialect) -> Block:
    w = "OVER (PARTITION BY id ORDER BY standardized, period ROWS UNBOUNDED PRECEDING)"
    s = "sqrt(greatest(n0 * 1e0 * n1 / (n0 + n1), 1e0))"
    return Block(
        [
            f"ka AS (SELECT id, sum(CASE WHEN period = 0 THEN 1 ELSE 0 END) {w} AS c0, sum(CASE WHEN period = 1 THEN 1 ELSE 0 END) {w} AS c1, "
            "sum(CASE WHEN period = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY id) AS n0, sum(CASE WHEN period = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY id) AS n1 FROM p)",
            "kb AS (SELECT id, max(n0) AS n0, max(n1) AS n1, max(abs(c0 * 1e0 / n0 - c1 * 1e0 / n1)) AS gap FROM ka GROUP BY id)",
        ],
        "kb",
        {"ks_norm": f"({s} + 0.12e0 + 0.11e0 / {s}) * gap"},
        grouped=False,
    )


def js(d: Dialect) -> Block:
    """Bins between distinct BEFORE quantiles, the last closed on the right; values outside are left out."""
    edges = [f"SELECT id, {d.quantile('standardized', i / (JS_EDGES - 1))} AS edge FROM p WHERE period = 0 GROUP BY id" for i in range(JS_EDGES)]
    return Block(
        [
            "ja AS (SELECT DISTINCT id, edge FROM (" + " UNION ALL ".join(edges) + ") edges_)" if d.name != "spark" else
            f"ja AS (SELECT DISTINCT id, edge FROM (SELECT id, percentile(standardized, array({', '.join(str(i / (JS_EDGES - 1)) for i in range(JS_EDGES))})) AS edges FROM p WHERE period = 0 GROUP BY id) LATERAL VIEW explode(edges) e_ AS edge)",
            "jb AS (SELECT id, edge AS low, lead(edge) OVER (PARTITION BY id ORDER BY edge) AS high, lead(edge, 2) OVER (PARTITION BY id ORDER BY edge) IS NULL AS is_last FROM ja)",
            "jc AS (SELECT jb.id, low, sum(CASE WHEN period = 0 THEN 1 ELSE 0 END) AS k0, sum(CASE WHEN period = 1 THEN 1 ELSE 0 END) AS k1 FROM jb "
            "LEFT JOIN p ON p.id = jb.id AND standardized >= low AND (standardized < high OR is_last AND standardized = high) WHERE high IS NOT NULL GROUP BY jb.id, low)",
            "jd AS (SELECT id, (k0 + 0.5e0) / sum(k0 + 0.5e0) OVER (PARTITION BY id) AS a, (k1 + 0.5e0) / sum(k1 + 0.5e0) OVER (PARTITION BY id) AS b FROM jc)",
            "je AS (SELECT id, 0.5e0 * sum(a * (ln(a) - ln((a + b) / 2e0)) + b * (ln(b) - ln((a + b) / 2e0))) AS js FROM jd GROUP BY id)",
            "jf AS (SELECT i.id, coalesce(js, 0e0) AS js FROM (SELECT DISTINCT id FROM p) i LEFT JOIN je ON i.id = je.id)",
        ],
        "jf",
        {"js_divergence": "js"},
        grouped=False,
    )


def perm_entropy(d: Dialect) -> Block:
    ctes, cols = [], {}
    for m, factorial in ((3, 6), (5, 120)):
        xs = ["x0", *(f"x{i}" for i in range(1, m))]
        # The rank of a place counts smaller values, and equal ones before it.
        code = " + ".join(f"power({m + 1}e0, {i}e0) * (" + " + ".join(f"CASE WHEN {xs[j]} {'<=' if j < i else '<'} {xs[i]} THEN 1 ELSE 0 END" for j in range(m) if j != i) + ")" for i in range(m))
        ctes += [
            f"pa{m} AS (SELECT id, period, standardized AS x0, " + ", ".join(f"lead(standardized, {i}) {W} AS x{i}" for i in range(1, m)) + " FROM p)",
            f"pb{m} AS (SELECT id, period, {code} AS pattern FROM pa{m} WHERE x{m - 1} IS NOT NULL)",
            f"pc{m} AS (SELECT id, period, pattern, count(*) * 1e0 AS c FROM pb{m} GROUP BY id, period, pattern)",
            f"pd{m} AS (SELECT id, period, c / sum(c) OVER (PARTITION BY id, period) AS q FROM pc{m})",
            f"pe{m} AS (SELECT id, period, -sum(q * ln(q + {EPS})) / (ln({factorial}e0) + {EPS}) AS h{m} FROM pd{m} GROUP BY id, period)",
        ]
        cols[f"perm_entropy_m{m}_delta"] = f"{after(f'coalesce(h{m}, 0e0)')} - {before(f'coalesce(h{m}, 0e0)')}"
    ctes.append("pf AS (SELECT i.id, i.period, h3, h5 FROM (SELECT DISTINCT id, period FROM p) i LEFT JOIN pe3 ON i.id = pe3.id AND i.period = pe3.period LEFT JOIN pe5 ON i.id = pe5.id AND i.period = pe5.period)")
    return Block(ctes, "pf", cols)


def spectral(d: Dialect) -> Block:
    bands = [(0.0, 0.05), (0.05, 0.15), (0.15, 0.3), (0.3, 0.5)]
    share = lambda lo, hi: f"sum(CASE WHEN f >= {lo}e0 AND f < {hi}e0 THEN p ELSE 0e0 END) / (sum(p) + {EPS})"
    parts = ", ".join(f"CASE WHEN sum(p) <= 0 THEN 0e0 ELSE {share(*b)} END AS b{i}" for i, b in enumerate(bands, 1))
    return Block(
        [*psd_join("p", "detrended", "sp", d), f"sq AS (SELECT id, period, exp(avg(ln(p + {EPS}))) / avg(p + {EPS}) AS flat, {parts} FROM sp GROUP BY id, period)"],
        "sq",
        {"spec_flatness_logratio": log_ratio(after("flat"), before("flat"))} | {f"bandpower_b{i}_logratio": log_ratio(after(f"b{i}"), before(f"b{i}")) for i in (1, 2, 3, 4)},
    )


def differences(d: Dialect) -> Block:
    x = "diff_standardized"
    up, down = crossings("x", "following", "0e0")
    return Block(
        [
            *_levels(d, x, "db"),
            f"da AS (SELECT id, period, n, {x} AS x, lead({x}) {W} AS following FROM p)",
            f"dc AS (SELECT da.id, period, max(n) AS m, {count('abs(x) > 3e0')} AS far3, {count('x > b95')} AS above, {count('x < b5')} AS below, {count(up)} + {count(down)} AS flips FROM da JOIN db ON da.id = db.id GROUP BY da.id, period)",
            *acf("p", "diff_detrended", LBQ_LAGS, "dm"),
            *acf("p", "absdiff_detrended", 1, "dn"),
            *psd_join("p", "diff_detrended", "dp", d), centroid("dp", "dq"),
            "dt AS (SELECT dm.*, m, far3, above, below, flips, centroid, dn.r1 AS a1 FROM dm JOIN dc ON dm.id = dc.id AND dm.period = dc.period "
            "JOIN dn ON dm.id = dn.id AND dm.period = dn.period JOIN dq ON dm.id = dq.id AND dm.period = dq.period)",
        ],
        "dt",
        {
            "diff_abs_excd_3_logit_delta": delta(jeffreys("far3", "m")), "diff_up_excd_q95_logit_delta": delta(jeffreys("above", "m")),
            "diff_low_excd_q5_logit_delta": delta(jeffreys("below", "m")), "diff_signflips_logit_delta": delta(jeffreys("flips", "m - 1")),
            "diff_shortlag_l1_delta": delta(shortlag(ACF_LAGS)), "diff_lbq_stat_delta": delta(ljung_box(LBQ_LAGS)),
            "diff_spec_centroid_delta": delta("centroid"), "absdiff_acf1_delta": delta("a1"),
        },
    )


def boundary_local(w: int) -> Callable[[Dialect], Block]:
    """On the last w rows of BEFORE and the first w of AFTER."""

    def block(d: Dialect) -> Block:
        z, dz, dd = "standardized", "diff_standardized", "diff2_standardized"
        up, down = crossings(z, "following", "0e0")
        series = "original, standardized, clipped, detrended, diff_standardized, diff2_standardized, diff2_detrended"
        grids = ", ".join(f"{d.quantile(z, q)} AS q{round(q * 100)}, {d.quantile(dd, q)} AS e{round(q * 100)}" for q in COARSE)
        q = [round(x * 100) for x in COARSE]
        wasserstein = lambda c: "(" + " + ".join(f"abs({after(f'{c}{k}')} - {before(f'{c}{k}')})" for k in q) + f") / {len(q)}"
        ssr = lambda c: f"({c}yy - CASE WHEN {c}xx > 0 THEN {c}xy * {c}xy / {c}xx ELSE 0e0 END)"
        gap = "(last_x - first_x) * 1e0 / greatest(crossings - 1, 1)"
        residence = f"CASE WHEN crossings = 0 THEN 0e0 WHEN crossings = 1 THEN {log(f'(n - 1) / 2e0 + {EPS}')} ELSE {log(f'{gap} + {EPS}')} END"
        asym = "CASE WHEN ups + downs = 0 THEN 0e0 ELSE (ups - downs) * 1e0 / (ups + downs + 1) END"
        return Block(
            [
                *_levels(d, z, "lv"),
                f"lw AS (SELECT id, period, CASE WHEN period = 0 THEN t - greatest(n - {w}, 0) ELSE t END AS t, least(n, {w}) AS n, {series} FROM p WHERE period = 0 AND t >= n - {w} OR period = 1 AND t < {w})",
                *mads("lw", [z, dz, dd], "lm"),
                f"lx AS (SELECT *, lead({z}) {W} AS following FROM lw)",
                f"lc AS (SELECT lx.id, period, max(n) AS n, {count(f'abs({z}) > b95')} AS far, {count(f'abs({z}) > 3e0')} AS far3, {count(up)} AS ups, {count(down)} AS downs, {count(f'{up} OR {down}')} AS crossings, "
                f"min(CASE WHEN {up} OR {down} THEN t END) AS first_x, max(CASE WHEN {up} OR {down} THEN t END) AS last_x FROM lx JOIN lv ON lx.id = lv.id GROUP BY lx.id, period)",
                f"ls AS (SELECT id, period, {slope('detrended')} AS slope, sqrt(avg(detrended * detrended)) AS rms, {grids}, avg({z}) AS zm, var_pop({z}) AS zv, sum(detrended) AS ds, sum(detrended * detrended) AS dss FROM lw GROUP BY id, period)",
                *acf("lw", "detrended", LOCAL_LAGS, "la"), *acf("lw", "diff2_detrended", 1, "lb"),
                *psd_join("lw", "detrended", "lp", d), centroid("lp", "lq"),
                # Cliff's delta from counts of smaller and equal BEFORE values.
                f"lk AS (SELECT id, period, sum(CASE WHEN period = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY {z} RANGE UNBOUNDED PRECEDING) AS up_to, "
                f"sum(CASE WHEN period = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY id, {z}) AS ties, sum(CASE WHEN period = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY id) AS nb FROM lw)",
                "ll AS (SELECT id, sum((up_to - ties) - (nb - up_to)) * 1e0 / (count(*) * max(nb)) AS cliff FROM lk WHERE period = 1 GROUP BY id)",
                # Sums for the lines of each side and of both together.
                f"lt AS (SELECT id, period, clipped AS y, t, CASE WHEN period = 1 THEN t + nb ELSE t END AS u FROM (SELECT *, sum(CASE WHEN period = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY id) AS nb FROM lw) both_sides)",
                "lh AS (SELECT id, " + ", ".join(
                    f"var_pop(CASE WHEN {c} THEN {a} END) * count(CASE WHEN {c} THEN 1 END) AS {s}xx, var_pop(CASE WHEN {c} THEN y END) * count(CASE WHEN {c} THEN 1 END) AS {s}yy, "
                    f"covar_pop(CASE WHEN {c} THEN y END, CASE WHEN {c} THEN {a} * 1e0 END) * count(CASE WHEN {c} THEN 1 END) AS {s}xy"
                    for s, c, a in (("b", "period = 0", "t"), ("a", "period = 1", "t"), ("p", "period >= 0", "u"))
                ) + " FROM lt GROUP BY id)",
                f"li AS (SELECT id, {ssr('p')} AS sp, (CASE WHEN bxx > 0 THEN {ssr('b')} ELSE 0e0 END) + (CASE WHEN axx > 0 THEN {ssr('a')} ELSE 0e0 END) AS sb FROM lh)",
                "lz AS (SELECT lm.id, lm.period, lc.n, far, far3, ups, downs, crossings, first_x, last_x, slope, rms, zm, zv, ds, dss, " + ", ".join(f"q{k}, e{k}" for k in q)
                + f", med_{z}, mad_{z}, med_{dz}, mad_{dd}, " + ", ".join(f"la.r{k}" for k in range(1, LOCAL_LAGS + 1)) + ", lb.r1 AS dd1, centroid, cliff, sp, sb FROM lm "
                + " ".join(f"JOIN {x} ON lm.id = {x}.id AND lm.period = {x}.period" for x in ("lc", "ls", "la", "lb", "lq")) + " JOIN ll ON lm.id = ll.id JOIN li ON lm.id = li.id)",
                f"ly AS (SELECT id, sum(n) AS n, {before('n')} AS n0, {after('n')} AS n1, {before('zm')} AS m0, {after('zm')} AS m1, {before('zv')} AS v0, {after('zv')} AS v1, {after('ds')} AS sa, sum(ds) AS sd, sum(dss) AS sdd FROM lz GROUP BY id)",
                "lr AS (SELECT lz.*, ly.n AS nn, n0, n1, m0, m1, v0, v1, sa, sd, sdd FROM lz JOIN ly ON lz.id = ly.id)",
            ],
            "lr",
            {f"{k}_w{w}": v for k, v in {
                "local_median_jump": delta(f"med_{z}"), "local_MAD_logratio": delta(f"ln(1.4826e0 * mad_{z} + {EPS})"), "local_slope_jump": delta("slope"),
                "local_IDR_logratio": delta(f"ln(q90 - q10 + {EPS})"), "local_abs_excd_q95_logit_delta": delta(jeffreys("far", "n")), "local_abs_excd_3_logit_delta": delta(jeffreys("far3", "n")),
                "local_signflips_logit_delta": delta(jeffreys("ups + downs", "n - 1")), "local_med_cross_asym_fisher_delta": delta(fisher(f"({asym})")),
                "local_res_time_logratio": delta(f"({residence})"), "local_acf1_delta": delta("r1"), "local_shortlag_L1_delta": delta(shortlag(LOCAL_LAGS)), "local_spec_centroid_delta": delta("centroid"),
                "local_w1_scaled": f"{wasserstein('q')} / greatest(greatest({before('(q75 - q25)')}, {EPS}), 1e-8)", "local_rms_logratio": delta(f"ln(rms + {EPS})"),
                "local_cliffs_fisher_delta": fisher("max(cliff)"),
                "local_chow_F": "CASE WHEN max(sb) > 0 THEN greatest((max(sp) - max(sb)) / 2e0 / (max(sb) / greatest(max(nn) - 4, 1)), 0e0) ELSE 0e0 END",
                "local_cusum_signed": f"CASE WHEN max(nn) < 3 THEN 0e0 ELSE (max(sa) - max(n1) * max(sd) / max(nn)) / ((sqrt(greatest(max(sdd) / max(nn) - power(max(sd) / max(nn), 2e0), 0e0)) + {EPS}) * sqrt(max(nn) * 1e0)) END",
                "local_gauss_glr": f"CASE WHEN max(n0) <= 1 OR max(n1) <= 1 THEN 0e0 ELSE max(nn) * ln(greatest((max(n0) * max(v0) + max(n1) * max(v1)) / max(nn) + max(n0) * max(n1) * power((max(m0) - max(m1)) / max(nn), 2e0), {EPS})) "
                                   f"- max(n0) * ln(greatest(max(v0), {EPS})) - max(n1) * ln(greatest(max(v1), {EPS})) END",
                "local_diff_median_jump": delta(f"med_{dz}"), "local_dd_MAD_logratio": delta(f"ln(1.4826e0 * mad_{dd} + {EPS})"), "local_dd_acf1_delta": delta("dd1"),
                "local_dd_w1_scaled": f"{wasserstein('e')} / greatest({before('(e90 - e10)')} + {EPS}, 1e-8)",
            }.items()},
        )

    return block


def boundary_edge(d: Dialect) -> Block:
    z = "standardized"
    starts = {o: f"least({o}, n - 1)" for o in EDGE_OFFSETS}
    medians = ", ".join(f"median(CASE WHEN period = 1 AND t >= {s} AND t < {s} + {EDGE} THEN {z} END) AS v{o}" for o, s in starts.items())
    names = ["b", *map(str, EDGE_OFFSETS)]
    ranks = ", ".join(f"(sum(CASE WHEN {z} < v{o} THEN 1 ELSE 0 END) + 0.5e0 * sum(CASE WHEN {z} = v{o} THEN 1 ELSE 0 END)) AS k{o}" for o in names)
    # Logits of the same size and unlike signs are ties but for the last digit of the logarithm, so both engines need the same one.
    logit = lambda o: jeffreys(f"k{o}", "m").replace("ln(", "libm_ln(" if d.name == "spark" else "ln(")
    dz = {o: f"(v{o} - vb)" for o in EDGE_OFFSETS}
    rank = {o: f"(({logit(o)}) - ({logit('b')}))" for o in EDGE_OFFSETS}

    def furthest(of: dict[int, str]) -> str:
        """The value of the largest magnitude, of the first offset on ties."""
        expression, later = "", list(of.values())
        for i, v in enumerate(later[:-1]):
            others = ", ".join(f"abs({x})" for x in later[i + 1 :])
            most = f"greatest({others})" if len(later) - i > 2 else others
            expression += f"WHEN abs({v}) >= {most} THEN {v} "
        return f"CASE {expression}ELSE {later[-1]} END"

    return Block(
        [
            f"ea AS (SELECT id, median(CASE WHEN period = 0 AND t >= n - {EDGE} THEN {z} END) AS vb, {medians} FROM p GROUP BY id)",
            f"eb AS (SELECT p.id, count(*) AS m, {', '.join(f'max(v{o}) AS v{o}' for o in names)}, {ranks} FROM p JOIN ea ON p.id = ea.id WHERE period = 0 GROUP BY p.id)",
        ],
        "eb",
        {f"edge_dz_o{o}": dz[o] for o in EDGE_OFFSETS} | {f"edge_ranklogit_delta_o{o}": rank[o] for o in EDGE_OFFSETS}
        | {"edge_dz_max_abs": furthest(dz), "edge_ranklogit_max_abs": furthest(rank)},
        grouped=False,
    )


def curvature(d: Dialect) -> Block:
    shared = f"least({LBQ_LAGS}, least(n0 - 1, n1 - 1))"
    q = " + ".join(f"CASE WHEN {k} <= lags THEN coalesce(r{k} * r{k}, 0e0) / greatest(n - {k}, 1) ELSE 0e0 END" for k in range(1, LBQ_LAGS + 1))
    lbq = f"CASE WHEN lags >= 1 AND n > lags THEN (n * (n + 2e0) * ({q}) - lags) / sqrt(2e0 * lags) ELSE 0e0 END"
    energy, steep = "ee", "de"
    return Block(
        [
            f"ca AS (SELECT id, period, count(*) AS m, avg(diff2_standardized * diff2_standardized) AS {energy}, avg(diff_standardized * diff_standardized) AS {steep}, {count('diff2_standardized > 0')} AS positive FROM p GROUP BY id, period)",
            *acf("p", "diff2_detrended", LBQ_LAGS, "cr"),
            *psd_join("p", "diff2_detrended", "cp", d), centroid("cp", "cq"),
            f"cl AS (SELECT id, {before('n')} AS n0, {after('n')} AS n1 FROM cr GROUP BY id)",
            f"ct AS (SELECT cr.*, m, {energy}, {steep}, positive, centroid, {shared} AS lags FROM cr JOIN ca ON cr.id = ca.id AND cr.period = ca.period JOIN cq ON cr.id = cq.id AND cr.period = cq.period JOIN cl ON cr.id = cl.id)",
        ],
        "ct",
        {
            "curv_energy_logratio": delta(f"ln({energy} + {EPS})"), "curv_vs_slope_logratio": delta(f"ln({energy} / ({steep} + {EPS}) + {EPS})"),
            "dd_posrate_logit_delta": delta(jeffreys("positive", "m")), "dd_acf1_delta": delta("r1"), "dd_shortlag_L1_delta": delta(shortlag(ACF_LAGS)),
            "dd_lbq_z_delta": delta(f"({lbq})"), "dd_spec_centroid_delta": delta("centroid"),
        },
    )


def rolling(d: Dialect) -> Block:
    """Jumps between adjacent windows, from one pass of running frames per width."""
    up, down = crossings("clipped", "following", "0e0")
    ctes = [f"oa AS (SELECT id, period, t, n, clipped, diff_detrended, lead(clipped) {W} AS following FROM p)", f"ob AS (SELECT *, CASE WHEN {up} OR {down} THEN 1 ELSE 0 END AS crossing FROM oa)"]
    columns, names = {}, []
    for w in ROLL_WINDOWS:
        frame = f"OVER (PARTITION BY id, period ORDER BY t ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)"
        short = f"OVER (PARTITION BY id, period ORDER BY t ROWS BETWEEN CURRENT ROW AND {w - 2} FOLLOWING)"
        p = f"least(greatest((crossing_w + 0.5e0) / {w}e0, {EPS}), 1e0 - {EPS})"
        ctes += [
            f"oc{w} AS (SELECT id, period, t, n, avg(clipped) {frame} AS m1, avg(clipped * clipped) {frame} AS m2, avg(diff_detrended * diff_detrended) {frame} AS d2, sum(crossing) {short} AS crossing_w FROM ob)",
            f"od{w} AS (SELECT id, period, t, n, ln(sqrt(greatest(m2 - m1 * m1, 0e0)) + {EPS}) AS s, ln(sqrt(greatest(d2, 0e0)) + {EPS}) AS r, ln({p}) - ln(1e0 - {p}) AS c FROM oc{w} WHERE t <= n - {w})",
            f"oe{w} AS (SELECT id, period, " + ", ".join(f"lead({x}, {w}) {W} - {x} AS {x}" for x in "src") + f" FROM od{w} WHERE n - 2 * {w} + 1 >= {ROLL_LEAST})",
            f"of{w} AS (SELECT *, " + ", ".join(f"row_number() OVER (PARTITION BY id, period ORDER BY abs({x}) DESC) AS k{x}" for x in "src") + f" FROM oe{w} WHERE s IS NOT NULL)",
            f"og{w} AS (SELECT id, period, " + ", ".join(f"max({x}) AS {x}{w}_hi, min({x}) AS {x}{w}_lo, avg(CASE WHEN k{x} <= {ROLL_TOP} THEN abs({x}) END) AS {x}{w}_top" for x in "src") + f" FROM of{w} GROUP BY id, period)",
        ]
        for x, family in (("s", "roll_logstd_jump"), ("r", "roll_rms_jump"), ("c", "roll_crossrate_logit")):
            for end, name in (("hi", "maxpos"), ("lo", "maxneg"), ("top", "topkabs_mean")):
                c = f"{x}{w}_{end}"
                names.append(c)
                columns[f"{family}_w{w}_{name}_delta"] = f"coalesce({after(c)} - {before(c)}, 0e0)"
    joins = " ".join(f"LEFT JOIN og{w} ON i.id = og{w}.id AND i.period = og{w}.period" for w in ROLL_WINDOWS)
    ctes.append(f"oz AS (SELECT i.id, i.period, {', '.join(names)} FROM (SELECT DISTINCT id, period FROM p) i {joins})")
    return Block(ctes, "oz", columns)


def ewvar(d: Dialect) -> Block:
    """The last exponentially weighted mean of squares as a weighted sum, without recursion."""
    parts = []
    for h in HALF_LIVES:
        keep = f"power(2e0, -1e0 / {h})"
        parts.append(f"sum(clipped * clipped * power({keep}, n - 1e0 - t) * CASE WHEN t = 0 THEN 1e0 ELSE 1e0 - {keep} END) AS v{h}")
    return Block([f"ew AS (SELECT id, period, {', '.join(parts)} FROM p GROUP BY id, period)"], "ew", {f"ewvar_hl{h}_logratio": delta(f"ln(v{h} + {EPS})") for h in HALF_LIVES})


def ar1(d: Dialect) -> Block:
    """AR(1) with a ridge from sums over lag pairs; null where the negative log likelihoods have no logarithm or BEFORE is too short."""
    nll = f"avg(0.5e0 * (ln(2e0 * pi() * (s2 + 1e-12)) + power(y - c - phi * x, 2e0) / (s2 + 1e-12)))"
    return Block(
        [
            f"aa AS (SELECT id, {before('n')} AS nb, {after('n')} AS na, least({AR_CAP}, least({d.div(before('n'), '2')}, {after('n')})) AS h FROM p GROUP BY id)",
            f"ab AS (SELECT p.id, period, t, nb, h, detrended AS y, lag(detrended) OVER (PARTITION BY p.id, period ORDER BY t) AS x FROM p JOIN aa ON p.id = aa.id)",
            "ac AS (SELECT id, count(*) AS m, avg(y) AS my, avg(x) AS mx, covar_pop(y, x) * count(*) AS sxy, var_pop(x) * count(*) AS sxx FROM ab WHERE period = 0 AND t >= 1 AND t < nb - h GROUP BY id)",
            f"ad AS (SELECT id, sxy / (sxx + {AR_RIDGE}) AS phi, my - sxy / (sxx + {AR_RIDGE}) * mx AS c FROM ac)",
            f"ae AS (SELECT ab.id, max(phi) AS phi, max(c) AS c, avg(power(y - c - phi * x, 2e0)) + {EPS} AS s2 FROM ab JOIN ad ON ab.id = ad.id WHERE period = 0 AND t >= 1 AND t < nb - h GROUP BY ab.id)",
            # The first row of a scored window has no pair within the window.
            f"af AS (SELECT ab.id, period, {nll} AS nll FROM ab JOIN ae ON ab.id = ae.id WHERE period = 0 AND t > nb - h OR period = 1 AND t >= 1 AND t < h GROUP BY ab.id, period)",
            "ag AS (SELECT i.id, f.period, f.nll FROM aa i LEFT JOIN af f ON i.id = f.id)",
            f"ah AS (SELECT id, {after('nll')} + {EPS} AS a, {before('nll')} + {EPS} AS b FROM ag GROUP BY id)",
        ],
        "ah",
        {"ar_ridge_nll_logratio": "CASE WHEN a / b > 0 THEN ln(a / b) END"},
        grouped=False,
    )


#: Every block that SQL expresses, by name.
BLOCKS: dict[str, Callable[[Dialect], Block]] = {
    "moments": moments, "quantiles": quantiles, "rates": rates, "autocorr": autocorr, "glr_css": glr_css, "ks": ks, "js": js, "spectral": spectral, "perm_entropy": perm_entropy,
    "differences": differences, "absolute": absolute, "squared": squared, **{f"boundary_local_w{w}": boundary_local(w) for w in LOCAL_WINDOWS},
    "boundary_edge": boundary_edge, "curvature": curvature, "rolling": rolling, "ewvar": ewvar, "ar1": ar1,
}
