import hashlib
import math
from collections import Counter

import duckdb
import pytest

from driftline.llm import mixing


def repeats(who, rate, seed=mixing.SEED):
    u = (int(hashlib.md5(f"{seed}|{who}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    total, k = math.exp(-rate), 0
    while total <= u:
        k += 1
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
    return k


def test_against_brute_force(spark, stored, awkward):
    rows = awkward + [(100 + i, f"text {i}", "en", "hot" if i % 3 else "cold") for i in range(300)]
    weights = {"hot": 1.0, "cold": 3.0, "a": 0.5}
    found = mixing.mix(stored(rows), weights, rows=900).collect()
    n = Counter(s for *_, s in rows)
    want = Counter()
    for i, t, _, s in rows:
        if s in weights:
            who = str(i) if i is not None else hashlib.md5(t.encode()).hexdigest() if t is not None else ""
            want[(i, t, s)] += repeats(who, 900 * weights[s] / 4.5 / n[s])
    assert Counter((r.doc_id, r.text, r.source) for r in found) == +want
    assert abs(sum(r.source == "cold" for r in found) - 600) < 100
    assert {r.name for r in found} == {"x"}


def test_oracle_agrees(spark, stored):
    docs = stored([(i, f"t{i}", "en", f"s{i % 7 % 3}") for i in range(200)])
    found = mixing.mix(docs)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.execute(f"SELECT doc_id, mix_copy, mix_key FROM ({mixing.mixed_sql('documents')})").fetchall()
    assert sorted((r.doc_id, r.mix_copy, r.mix_key) for r in found.collect()) == sorted(want)


def test_large_rates_and_empty(spark, stored):
    assert 1700 < mixing.mix(stored([(1, "a", "en", "s"), (2, "b", "en", "s")]), rows=2000, added=False).count() < 2300
    assert mixing.mix(stored([])).count() == 0
    assert mixing.mix(stored([(1, "a", "en", "s")]), {"other": 1.0}).count() == 0
    assert mixing.mix(stored([(1, "a", "en", "s")]), added=False).columns == stored([]).columns


@pytest.mark.parametrize("files", [1, 3])
def test_independent_of_partitions(spark, stored, awkward, files):
    found = mixing.mix(stored(awkward, files)).select("doc_id", "mix_copy", "mix_key").collect()
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix(stored(awkward)).select("doc_id", "mix_copy", "mix_key").collect()))
