import struct
import zlib

import xxhash
from pyspark.sql import functions as F

from driftline.llm import sharding


def place(number, n, seed=sharding.SEED):
    """The permutation in plain Python."""
    import math

    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    b = -(-n // a)
    h = lambda k, x: xxhash.xxh64(struct.pack("<q", x), seed=xxhash.xxh64(struct.pack("<q", k), seed=42).intdigest()).intdigest()
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    while True:
        left, right = divmod(number, b)
        for k in sharding.round_keys(seed):
            if k % 2 == 0:
                left = (left + signed(h(k, right)) % a) % a
            else:
                right = (right + signed(h(k, left)) % b) % b
        number = left * b + right
        if number < n:
            return number


def test_permutation_is_one_and_computable(spark):
    for n in (1, 2, 3, 7, 64, 1001):
        rows = spark.range(n).select("id", sharding.permuted(F.col("id"), n).alias("p")).collect()
        assert sorted(r.p for r in rows) == list(range(n))
        assert all(r.p == place(r.id, n) for r in rows)


def test_law_and_awkward_rows(spark, stored, awkward):
    rows = awkward * 3
    found = sharding.shards(stored(rows), n_shards=4).collect()
    assert len(found) == len(rows)
    counts = [sorted(r.slot for r in found if r.shard == s) for s in range(4)]
    assert max(map(len, counts)) - min(map(len, counts)) <= 1
    assert all(c == list(range(len(c))) for c in counts)
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in found) == want
    assert {r.law for r in found} == {"rows"} and {r.grown_shard for r in found} == {None}


def test_same_rows_same_shards(spark, stored, awkward):
    one = sharding.shards(stored(awkward, 1)).collect()
    two = sharding.shards(stored(list(reversed(awkward)), 3)).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))


def test_empty_table(spark, stored):
    assert sharding.shards(stored([])).count() == 0
