"""Quality rules and robust multivariate outliers.

One pass over the whole texts counts; fixed rules on the counts (the base) fail a document at once.
Documents that pass them are judged by the minimum covariance determinant (MCD): the vector of
transformed statistics of a document (FEATURES) is compared, by its Mahalanobis distance, with the
centre and covariance of the most concentrated share COVERAGE of its group's documents.

Estimates are per language and source, over all documents of the group that pass the base. They
start from coordinate medians and MADs and are improved by concentration steps, each of which takes
the documents nearest to the estimate (their distance below the group's quantile) and estimates
again from these, until no group's quantile moves or for `steps` steps. Quantiles are read from
counts by bin, keyed by group and bin, and estimates from sums; both are combined map-side, so that
a hot group is spread over tasks and only counts and sums move. Seven means and 28 covariances
need some documents: groups under min_rows are pooled by language, and what is left of languages
under min_rows in one pool; a pool under fewest documents rejects none.

The covariance gets the factor that makes it consistent for normal data, and FLOORS, the squared
noise that is granted to each feature, on its diagonal: most documents have no symbols or repeats
at all, and a covariance of zero would reject the first that has one. A document is rejected if its
squared distance exceeds the chi-squared quantile of 1 - tail.

Defined results: a null text has no words and fails the base, and so does an empty one; null
languages and sources are groups of their own; repeated rows and null doc_ids are documents of
their own; very long texts are read whole; documents of one distance are judged alike; an empty table
gives an empty result. Other columns are left alone, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm.common import free, materialise, table

FEATURES = ["word_length", "symbols", "dup_lines", "repeats", "stutter", "upper", "punctuation"]
#: Granted standard deviations of the features.
FLOORS = [0.06, 0.09, 0.25, 0.2, 0.12, 0.05, 0.1]
COVERAGE, STEPS, TAIL, MIN_ROWS, FEWEST = 0.75, 12, 1e-6, 50, 10
#: Width of the bins that quantiles are read from, of features and of the logarithm of squared distances; bins are first counted by 1 << FINE.
RESOLUTION, LOG_STEP, FINE = 2e-7, 5e-7, 12
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
_SYMBOLS, _MARKS, _UPPER, _SPACE = b"#*$%&|<>", b".,;:!?", bytes(range(65, 91)), b" \t\n\x0b\x0c\r"
_LATER = bytes(range(0x80, 0xC0))
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_P = len(FEATURES)


def chi2_cdf(x: float, k: int) -> float:
    """By the series of the lower incomplete gamma function."""
    a, y = k / 2, x / 2
    if y <= 0:
        return 0.0
    term = total = math.exp(a * math.log(y) - y - math.lgamma(a + 1))
    i = a
    while term > 1e-17 * total:
        i += 1
        term *= y / i
        total += term
    return min(1.0, total)


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 20.0 * k + 200
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def repeat_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows that are found at least twice, each word once."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    key = np.zeros(n, np.uint64)
    for i in range(window):
        key = key * np.uint64(0xD6E8FEB86659FD93) + mixed[i : i + n]
    _, at, often = np.unique(key, return_inverse=True, return_counts=True)
    edge = np.zeros(len(ids) + 1, np.int64)
    found = np.flatnonzero(often[at] > 1)
    np.add.at(edge, found, 1)
    np.add.at(edge, found + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def statistics(text: bytes, serial: dict[bytes, int]) -> tuple[int, ...]:
    """The five counts, then lines with a word, words equal to the one before, capitals, marks."""
    words = text.split()
    for w in words:
        if w not in serial:
            serial[w] = len(serial)
    ids = np.fromiter(map(serial.__getitem__, words), np.int64, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    without = lambda chars: len(text) - len(text.translate(None, chars))
    chars = len(text) - without(_SPACE) - without(_LATER)
    stutter = int((ids[1:] == ids[:-1]).sum())
    return len(words), chars, without(_SYMBOLS), len(lines) - len(set(lines)), repeat_words(ids), len(lines), stutter, without(_UPPER), without(_MARKS)


def features(counts: np.ndarray) -> np.ndarray:
    """Rows of counts to rows of FEATURES: the logarithm of the mean word length and square roots of rates."""
    n, chars, symbols, dup, repeat, lines, stutter, upper, marks = counts.T.astype(float)
    one = np.maximum(n, 1)
    return np.column_stack([np.log((chars + 100) / (n + 20)), np.sqrt(symbols / one), np.sqrt(dup / np.maximum(lines, 1)), np.sqrt(repeat / one),
                            np.sqrt(stutter / one), np.sqrt(upper / np.maximum(chars, 1)), np.sqrt(marks / one)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    serial: dict[bytes, int] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            rows = []
            for text in part.column(3).cast(pa.binary()).to_pylist():
                if len(serial) > 500_000:
                    serial.clear()
                rows.append(statistics(text or b"", serial))
            counts = np.array(rows, np.int64).reshape(len(rows), 9)
            x = features(counts)
            arrays = [*part.columns[:3], *(pa.array(counts[:, i]) for i in range(5)), *(pa.array(x[:, i]) for i in range(_P))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang", "source", *_COUNTS, *(f"x{i}" for i in range(_P))])


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the five counts, base_failed and features x0.. of every row of docs."""
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(lang as string) lang", "cast(source as string) source", "cast(text as string) text")
    ddl = "doc_id bigint, lang string, source string, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", " + ", ".join(f"x{i} double" for i in range(_P))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.mapInArrow(_count, ddl).withColumn("base_failed", failed)


def _grouped(rows: DataFrame, min_rows: int) -> DataFrame:
    """rows with `pool`, the group they are judged in."""
    lang, source = (F.coalesce(F.concat(F.lit("="), c), F.lit("")) for c in ("lang", "source"))
    fine = rows.withColumns({"own": F.concat_ws("\x1f", lang, source), "wide": lang})
    sizes = materialise(fine.filter(~F.col("base_failed")).groupBy("own", "wide").agg(F.count("*").alias("m")), "sizes")
    small = sizes.filter(F.col("m") < min_rows).groupBy("wide").agg(F.sum("m").alias("m_wide"))
    pools = sizes.join(small, "wide", "left").select(
        "own", F.when(F.col("m") >= min_rows, F.concat(F.lit("own\x1f"), "own")).when(F.col("m_wide") >= min_rows, F.concat(F.lit("lang\x1f"), "wide")).otherwise(F.lit("all")).alias("pool")
    )
    return fine.join(materialise(pools, "pools"), "own", "left").drop("own", "wide")


def _moments() -> list:
    out = [F.count("*").cast("double").alias("m")] + [F.sum(f"x{i}").alias(f"s{i}") for i in range(_P)]
    return out + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i in range(_P) for j in range(i, _P)]


def _distance() -> F.Column:
    """Squared distance from centre c0.. under the precision matrix, whose upper triangle is p0_0.., in this order."""
    d = [F.col(f"x{i}") - F.col(f"c{i}") for i in range(_P)]
    total = F.lit(0.0)
    for i in range(_P):
        for j in range(i, _P):
            total = total + F.col(f"p{i}_{j}") * d[i] * d[j] * (1.0 if i == j else 2.0)
    return total


_ESTIMATE = ["pool", *(f"c{i}" for i in range(_P)), *(f"p{i}_{j}" for i in range(_P) for j in range(i, _P))]
_ESTIMATE_DDL = "pool string, " + ", ".join(f"{c} double" for c in _ESTIMATE[1:])


def _estimates(factor: float, floors: list[float]):
    """From moments to centre and precision, a row at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                mean = np.array([r[f"s{i}"] for i in range(_P)]) / r["m"]
                cov = np.zeros((_P, _P))
                for i in range(_P):
                    for j in range(i, _P):
                        cov[i, j] = cov[j, i] = r[f"q{i}_{j}"] / r["m"] - mean[i] * mean[j]
                precision = np.linalg.inv(factor * cov + np.diag(np.square(floors)))
                rows.append([r["pool"], *mean, *(precision[i, j] for i in range(_P) for j in range(i, _P))])
            yield pd.DataFrame(rows, columns=_ESTIMATE)

    return run


def _at_share(rows: DataFrame, keys: list[str], share: float) -> DataFrame:
    """keys and bin: the least bin up to which share of the group's rows lie, from rows (keys, bin).

    Counts by the bins' upper part find a stretch of 1 << FINE bins, counts of the rows in it the bin:
    a group has a bounded number of counts each time.
    """
    group = Window.partitionBy(*keys)
    parts = rows.groupBy(*keys, F.shiftright("bin", FINE).alias("part")).agg(F.count("*").alias("n"))
    placed = parts.withColumns({"upto": F.sum("n").over(group.orderBy("part")), "whole": F.sum("n").over(group)})
    found = placed.filter(F.col("upto") >= F.lit(share) * F.col("whole")).groupBy(*keys).agg(F.min(F.struct("part", (F.col("upto") - F.col("n")).alias("before"), "whole")).alias("at"))
    found = materialise(found.select(*keys, "at.*"), "parts")
    inner = rows.join(found, keys).filter(F.shiftright("bin", FINE) == F.col("part")).groupBy(*keys, "bin", "before", "whole").agg(F.count("*").alias("n"))
    reached = inner.withColumn("upto", F.col("before") + F.sum("n").over(group.orderBy("bin"))).filter(F.col("upto") >= F.lit(share) * F.col("whole"))
    return reached.groupBy(*keys).agg(F.min("bin").alias("bin"))


def _medians(rows: DataFrame, values: list[F.Column], name: str) -> DataFrame:
    """pool and the medians of the values, to RESOLUTION."""
    long = rows.select("pool", F.posexplode(F.array(*values)).alias("i", "x")).select("pool", "i", F.floor(F.col("x") / RESOLUTION).alias("bin"))
    middle = lambda i: F.max(F.when(F.col("i") == i, (F.col("bin") + 0.5) * RESOLUTION)).alias(f"{name}{i}")
    return _at_share(long, ["pool", "i"], 0.5).groupBy("pool").agg(*(middle(i) for i in range(len(values))))


def mcd(rows: DataFrame, coverage: float = COVERAGE, steps: int = STEPS, floors: list[float] | None = None) -> DataFrame:
    """An estimate for each pool, from rows with pool and x0..; one row per pool, written."""
    floors = floors or FLOORS
    factor = coverage / chi2_cdf(chi2_quantile(coverage, _P), _P + 2)
    centre = materialise(_medians(rows, [F.col(f"x{i}") for i in range(_P)], "c"), "centre")
    spread = _medians(rows.join(centre, "pool"), [F.abs(F.col(f"x{i}") - F.col(f"c{i}")) for i in range(_P)], "a").join(centre, "pool")
    first = {f"p{i}_{j}": (1 / (F.pow(1.4826 * F.col(f"a{i}"), F.lit(2.0)) + floors[i] ** 2)) if i == j else F.lit(0.0) for i in range(_P) for j in range(i, _P)}
    estimate, before = materialise(spread.withColumns(first).select(*_ESTIMATE), "estimate"), None
    for _ in range(steps):
        near = F.floor(F.ln(F.greatest(_distance(), F.lit(0.0)) + 1e-9) / LOG_STEP).alias("bin")
        far = rows.join(estimate, "pool").select("pool", *(f"x{i}" for i in range(_P)), near)
        bound = materialise(_at_share(far.select("pool", "bin"), ["pool"], coverage).withColumnRenamed("bin", "bound"), "bound")
        if before is not None and bound.exceptAll(before).isEmpty():
            break  # no group's nearest share reaches further or less far than in the step before
        sums = far.join(bound, "pool").filter("bin <= bound").groupBy("pool").agg(*_moments())
        last, estimate = estimate, materialise(sums.mapInPandas(_estimates(factor, floors), _ESTIMATE_DDL), "estimate")
        free(last)
        before = bound
    return estimate


def judge(docs: DataFrame, min_rows: int = MIN_ROWS, tail: float = TAIL, **mcd_options) -> DataFrame:
    """doc_id, the counts, base_failed, kept, distance (squared; null where not judged) for every row of docs."""
    rows = materialise(_grouped(materialise(counted(docs), "counts"), min_rows), "grouped")
    passed = rows.filter(~F.col("base_failed"))
    enough = passed.groupBy("pool").agg(F.count("*").alias("m")).filter(F.col("m") >= FEWEST).select("pool")
    estimate = mcd(passed, **mcd_options).join(enough, "pool")
    judged = rows.withColumn("pool", F.when(~F.col("base_failed"), F.col("pool"))).join(materialise(estimate, "estimate"), "pool", "left")
    far = F.when(~F.col("base_failed"), _distance())
    return judged.select("doc_id", *_COUNTS, "base_failed", (~F.col("base_failed") & (F.coalesce(far, F.lit(0.0)) <= chi2_quantile(1 - tail, _P))).alias("kept"), far.alias("distance"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
