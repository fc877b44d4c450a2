"""Mixing sources to target weights by Poisson replication.

A source of n rows with target weight w gets the mean repetition rate r = N * w / n, where N is the
wanted number of rows (that of the input unless given). Each row is repeated as often as a Poisson
variate of mean r says, drawn by inversion: the row's hash under a seed is a uniform number u, and
the count is the number of values k with P(X <= k) <= u. The copies are then shuffled globally, by
a hash of row and copy. All draws depend on the row and the seed only, so any run, retried task or
partitioning gives the same rows.

Weights: a mapping from source to weight, or none for n ** alpha (alpha < 1 lifts rare sources).
A source that a given mapping leaves out has weight 0. Counts per source are combined map-side; the
tables of inversion, about r + 12 sqrt(r) + 40 numbers a source, are joined by source, where Spark
broadcasts them only below its size threshold and may split a hot source otherwise.

Defined results: null is a source of its own. The row's identity is its doc_id, else the digest of
its text, so repeated rows repeat alike. An empty table gives an empty result, and so does a total
weight of 0. Columns of the input come back as they are; mix_rate, mix_copy and mix_key are added,
in place of input columns of these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm.common import materialise, table

ALPHA, SEED = 0.7, 17


def _number(digest):
    """The first 52 bits of a digest in hex."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def rates(docs: DataFrame, weights: dict[str, float] | None = None, rows: int | None = None, alpha: float = ALPHA) -> DataFrame:
    """source, n, rate: one row per source."""
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        counts = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(float(alpha))))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, weight double")
        counts = counts.join(given, F.col("source").eqNullSafe(F.col("name")), "left").select("source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    counts = materialise(counts, "sources")
    total, weight = counts.agg(F.sum("n"), F.sum("weight")).first()
    wanted = float(rows if rows is not None else total or 0)
    share = F.col("weight") / F.lit(float(weight)) if weight else F.lit(0.0)
    return counts.select("source", "n", (F.lit(wanted) * share / F.col("n")).alias("rate"))


def inversion(rates: DataFrame) -> DataFrame:
    """source, rate, cdf: P(X <= k) for k = 0, 1, ... up to where it is 1 in doubles."""
    k = F.explode(F.sequence(F.lit(0), F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 40).cast("int"))).alias("k")
    log_factorial = F.when(F.col("k") == 0, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest("k", F.lit(1))), F.lit(0.0), lambda a, i: a + F.ln(i.cast("double"))))
    terms = rates.filter("rate > 0").select("source", "rate", k).withColumn("p", F.exp(F.col("k") * F.ln("rate") - F.col("rate") - log_factorial))
    up_to = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    summed = terms.select("source", "rate", F.struct("k", F.sum("p").over(up_to).alias("c")).alias("at"))
    return summed.groupBy("source", "rate").agg(F.transform(F.sort_array(F.collect_list("at")), lambda x: x["c"]).alias("cdf"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, rows: int | None = None, alpha: float = ALPHA, seed: int = SEED, added: bool = True) -> DataFrame:
    """docs with each row as often as drawn, in a random global order; with the columns mix_* unless added is false."""
    draws = materialise(inversion(rates(docs, weights, rows, alpha)).withColumnRenamed("source", "mix_source"), "inversion")
    columns = [c for c in docs.columns if not (added and c in ("mix_rate", "mix_copy", "mix_key"))]
    who = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text").cast("string")), F.lit(""))
    held = docs.select(F.struct(*columns).alias("doc"), F.col("source").alias("own_source"), who.alias("who"))
    held = held.withColumn("u", (_number(F.md5(F.concat_ws("|", F.lit(str(seed)), "who"))).cast("double") + 0.5) / F.lit(2.0**52))
    drawn = held.join(draws, F.col("own_source").eqNullSafe(F.col("mix_source")))
    repeats = F.size(F.filter("cdf", lambda c: c <= F.col("u")))
    copies = drawn.withColumn("repeats", repeats).filter("repeats > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    keyed = copies.withColumn("mix_key", _number(F.md5(F.concat_ws("|", F.lit(str(seed)), "who", F.col("mix_copy").cast("string")))))
    shuffled = keyed.select("doc", "rate", "mix_copy", "mix_key").repartition("mix_key").sortWithinPartitions("mix_key")
    if not added:
        return shuffled.select("doc.*")
    return shuffled.select("doc.*", F.col("rate").alias("mix_rate"), F.col("mix_copy").cast("long").alias("mix_copy"), "mix_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).withColumn("mix_rate", F.round("mix_rate", 9))


def mixed_sql(docs: str) -> str:
    """DuckDB SQL for mix() with its default parameters over a table or subquery."""
    return f"""
WITH docs AS (SELECT * FROM {docs}),
c AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {ALPHA}) AS w FROM docs GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM c)::DOUBLE * (w / (SELECT sum(w) FROM c)) / n AS rate FROM c),
t AS (SELECT source, rate, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1.0))) OVER (PARTITION BY source ORDER BY k) AS cdf
      FROM (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT + 1)) AS k FROM r)),
a AS (SELECT source, rate, list(cdf ORDER BY k) AS cdfs FROM t GROUP BY source, rate),
u AS (SELECT docs.*, coalesce(doc_id::VARCHAR, md5(text), '') AS who FROM docs),
d AS (SELECT u.*, a.rate, len(list_filter(cdfs, lambda x: x <= (('0x' || substr(md5('{SEED}|' || who), 1, 13))::BIGINT + 0.5) / pow(2.0, 52))) AS repeats
      FROM u JOIN a ON u.source IS NOT DISTINCT FROM a.source),
e AS (SELECT *, unnest(range(1, repeats + 1)) AS mix_copy FROM d WHERE repeats > 0)
SELECT * EXCLUDE (who, rate, repeats), rate AS mix_rate, ('0x' || substr(md5('{SEED}|' || who || '|' || mix_copy), 1, 13))::BIGINT AS mix_key FROM e
"""


ORACLE_SQL = f"SELECT * REPLACE (round(mix_rate, 9) AS mix_rate) FROM ({mixed_sql('documents')})"
