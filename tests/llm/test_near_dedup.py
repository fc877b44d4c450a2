import random

import pytest

from driftline.llm import near_dedup as m


def brute(rows, words, percent):
    """component_id and set size of each row, by all pairs."""
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    ids = lambda i: [rows[k][0] for k in range(len(rows)) if root(k) == root(i) and rows[k][0] is not None]
    return [(rows[i][0], len(sets[i]), min(ids(i), default=None) if sets[i] else rows[i][0]) for i in range(len(rows))]


def edited(rng, base, edits, serial):
    words = list(base)
    for k in rng.sample(range(len(base)), edits):
        words[k] = f"x{serial}_{k}"
    return " ".join(words)


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_against_brute_force(spark, stored, awkward, words, percent):
    rng = random.Random(words)
    base = [f"w{i}" for i in range(120)]
    rows = awkward + [(100 + i, edited(rng, base, rng.choice([0, 1, 2, 3, 4, 5, 7]), i), "en", "s") for i in range(150)]
    found = m.near_duplicates(stored(rows), words=words, percent=percent).collect()
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in found))) == sorted(map(str, brute(rows, words, percent)))
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert sum(r.stays for r in found if r.n_shingles) == len({r.component_id for r in found if r.n_shingles and r.doc_id is not None and r.doc_id >= 100}) + sum(r.stays for r in found if r.n_shingles and (r.doc_id is None or r.doc_id < 100))


def test_signatures_estimate_similarity():
    shingler, rng = m.Shingler(3, 40, 5), random.Random(2)
    a = [f"a{rng.random()}" for _ in range(400)]
    one, two = (shingler.set_of(" ".join(x).encode()) for x in (a, a[:300] + [f"b{i}" for i in range(100)]))
    true = len(set(one) & set(two)) / len(set(one) | set(two))
    same = (shingler.signature(one) == shingler.signature(two)).mean()
    assert abs(same - true) < 0.12


def test_components(spark, tmp_path):
    links = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (300, 200)]
    path = str(tmp_path / "links.parquet")
    spark.createDataFrame([(max(x), min(x)) for x in links], "a long, b long").write.parquet(path)
    found = {r.node: r.component for r in m.components(spark.read.parquet(path)).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100, 200: 200, 300: 200}


def test_empty_tables(spark, stored):
    assert m.near_duplicates(stored([])).count() == 0
    found = m.near_duplicates(stored([(1, None, "en", "s"), (2, "", "en", "s")])).collect()
    assert [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in sorted(found)] == [(1, 0, 1, True), (2, 0, 2, True)]


def test_bands_make_misses_rare():
    for percent in (80, 85):
        assert (1 - (percent / 100) ** 5) ** m.n_bands(percent, 5, 1e-6) <= 1e-6


def test_cross_search_finds_links_between_components(spark, tmp_path):
    """All pairs at the threshold between different components, whatever the sizes of the sets, and few others."""
    rng, percent = random.Random(4), 80
    base = list(range(300))
    sets = {}
    for i in range(120):
        own = [s for s in base[: rng.choice([250, 280, 300])] if rng.random() > rng.choice([0.02, 0.06, 0.12])]
        sets[i] = sorted({*own, *(10_000 + 500 * i + j for j in range(rng.choice([0, 3, 10, 30])))})
    component = {i: i % 25 for i in sets}
    path = str(tmp_path)
    spark.createDataFrame([(i, component[i]) for i in sets], "node long, component long").write.parquet(f"{path}/mixed")
    spark.createDataFrame([(i, len(s), s) for i, s in sets.items()], "node long, n long, shingles array<long>").write.parquet(f"{path}/sets")
    stored_sets = spark.read.parquet(f"{path}/sets")
    pairs = m._cross_pairs(spark.read.parquet(f"{path}/mixed"), stored_sets, percent)
    both = lambda a, b: len(set(sets[a]) & set(sets[b]))
    want = {frozenset((a, b)) for a in sets for b in range(a) if component[a] != component[b] and 100 * both(a, b) >= percent * (len(sets[a]) + len(sets[b]) - both(a, b))}
    found = {frozenset(r) for r in pairs.collect()}
    assert want and want <= found and len(found) < 120 * 119 / 2
    assert {frozenset(r) for r in m.verified(pairs, stored_sets, percent).collect()} == want


def test_rows_may_be_named_by_a_column(spark, stored, awkward):
    docs = stored(awkward).withColumn("nr", 1000 - p_row())
    found = m.near_duplicates(docs, row="nr").collect()
    assert {r.row for r in found} == {r.nr for r in docs.collect()}


def p_row():
    from pyspark.sql import functions as F

    return F.monotonically_increasing_id()
