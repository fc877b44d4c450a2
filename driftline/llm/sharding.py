"""Sharding by a Feistel permutation of global row numbers. DataFrame functions only.

Rows get global numbers 0..n-1, a keyed permutation of 0..n-1 moves each number to its place p,
and p gives shard = p mod shards and slot = p div shards. Anyone who knows a row's number, n and
the key can compute where it lies, and which number lies at a given place, without any table.

The permutation is a Feistel network over Z_a x Z_b with a = ceil(sqrt n), b = ceil(n / a); results
of n or more are permuted again until they fall below n (cycle walking). a*b - n < a, so a walk is
rare, and one that has not ended after WALK steps raises an error instead of giving a wrong place:
with at most WALK excess numbers that cannot happen, else its chance is below (1/b)^WALK.

Numbering. Equal (doc_id, crc, size) rows are counted together map-side, spread over a fixed number
of buckets by a hash of these, ordered within their bucket and numbered from the bucket's offset.
The offsets, one row for each bucket, are the only thing that meets in one task or is broadcast.

Law `rows`: shard counts differ by one at most. Defined results: a null text has size 1 and crc 0;
null and repeated doc_ids are rows like others; equal rows get consecutive numbers. An empty table
gives an empty result. Other columns are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm.common import materialise, table

BUCKETS, ROUNDS, WALK, SEED = 4096, 6, 64, 20250101


def round_keys(seed: int) -> list[int]:
    return [seed * 1000 + i for i in range(ROUNDS)]


def feistel(number: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the network. Rounds are folded over a struct, so that no expression is repeated."""
    right = number % F.lit(b).cast("long")
    state = F.struct(F.floor((number - right) / F.lit(b)).alias("l"), right.alias("r"))  # exact below 2^53

    def one(s: Column, key: Column) -> Column:
        left_turn = F.struct(((s["l"] + F.pmod(F.xxhash64(key, s["r"]), F.lit(a).cast("long"))) % F.lit(a).cast("long")).alias("l"), s["r"].alias("r"))
        right_turn = F.struct(s["l"].alias("l"), ((s["r"] + F.pmod(F.xxhash64(key, s["l"]), F.lit(b).cast("long"))) % F.lit(b).cast("long")).alias("r"))
        return F.when(key % 2 == 0, left_turn).otherwise(right_turn)

    keys = F.array(*[F.lit(k).cast("long") for k in round_keys(seed)])
    return F.aggregate(keys, state, one, lambda s: s["l"] * F.lit(b).cast("long") + s["r"])


def permuted(number: Column, n: int, seed: int = SEED) -> Column:
    """The place of a row number under the permutation of 0..n-1."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    b = max(1, -(-n // a))
    first, size = feistel(number, a, b, seed), F.lit(n).cast("long")
    if a * b == n:
        return first
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda p, _: F.when(p < size, p).otherwise(feistel(p, a, b, seed)))
    # The finish step names the walk's end, so that it isn't computed twice.
    return F.aggregate(F.array(F.lit(0)), walk, lambda p, _: p, lambda p: F.when(p < size, p).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long")))


def numbered(rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """rows with `row_number` 0..n-1, the same for the same rows whatever their order, and n."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("copies"))
    spread = F.pmod(F.hash(*keys), F.lit(buckets))
    counted = materialise(counted.withColumn("bucket", spread), "rows")
    sizes = counted.groupBy("bucket").agg(F.sum("copies").alias("in_bucket"))
    ahead = F.sum("in_bucket").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_bucket")
    offsets = materialise(sizes.select("bucket", "in_bucket", ahead.alias("ahead")), "offsets")
    n = offsets.agg(F.sum("in_bucket")).first()[0] or 0
    before = F.sum("copies").over(Window.partitionBy("bucket").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies")
    ranked = counted.withColumn("before", before).join(F.broadcast(offsets), "bucket")  # offsets: `buckets` rows at most
    start = F.col("ahead") + F.col("before")
    return ranked.select(*keys, F.explode(F.sequence(start, start + F.col("copies") - 1)).alias("row_number")), n


def shards(docs: DataFrame, n_shards: int = 16, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number for every row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    all_rows, n = numbered(rows, ["doc_id", "text_crc32", "size"])
    placed = all_rows.withColumn("place", permuted(F.col("row_number"), n, seed))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("place") % n_shards).cast("int").alias("shard"),
        F.expr(f"place div {int(n_shards)}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))
