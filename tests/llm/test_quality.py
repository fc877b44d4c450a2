import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from driftline.llm import quality as m


def brute(text):
    words = text.encode().split()
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(i, i + 8))
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if x.encode().split():
            dup += x in seen
            seen.add(x)
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é\n#|\t\x0b中", max_size=120))
def test_counts(text):
    assert m.statistics(text.encode(), {})[:5] == brute(text)


def test_chi_squared():
    assert abs(m.chi2_cdf(9.037, 7) - 0.75) < 1e-3 and abs(m.chi2_quantile(0.95, 5) - 11.0705) < 1e-3


def prose(rng):
    return " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed", "do"]) + f"{rng.randrange(99)}" * (rng.random() < 0.5) for _ in range(rng.randint(40, 200))) + "."


def test_junk_goes_and_prose_stays(spark, stored, awkward):
    rng = random.Random(1)
    rows = awkward + [(1000 + i, prose(rng), "en" if i % 2 else None, "hot" if i % 3 else "b") for i in range(400)]
    rows += [(2000 + i, " | ".join(prose(rng).split()[:60]) + " ###", "en", "hot") for i in range(20)]
    found = {r.doc_id: r for r in m.judge(stored(rows)).collect()}
    assert all(found[1000 + i].kept for i in range(400))
    assert not any(found[2000 + i].kept for i in range(20))
    for i, t, *_ in rows:
        if i is not None and i not in (7, 9):
            r = found[i]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t or "")
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
            assert not (r.base_failed and r.kept)


def test_estimates_match_plain_mcd(spark, tmp_path):
    """Concentration steps in numpy, from the same start, with exact quantiles."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, [0.1, 0.2, 0.3, 0.1, 0.2, 0.1, 0.3], (400, 7)) + 1
    x[:40] += 3
    path = str(tmp_path / "x.parquet")
    spark.createDataFrame([("g", *map(float, r)) for r in x], "pool string, " + ", ".join(f"x{i} double" for i in range(7))).write.parquet(path)
    got = m.mcd(spark.read.parquet(path)).first()
    floors = np.square(m.FLOORS)
    c = np.array([np.sort(x[:, i])[199] for i in range(7)])
    d = (np.square(x - c) / (np.square(1.4826 * np.array([np.sort(abs(x[:, i] - c[i]))[199] for i in range(7)])) + floors)).sum(1)
    factor = m.COVERAGE / m.chi2_cdf(m.chi2_quantile(m.COVERAGE, 7), 9)
    for _ in range(m.STEPS):
        near = x[d <= np.sort(d)[299]]
        c, p = near.mean(0), np.linalg.inv(factor * np.cov(near.T, bias=True) + np.diag(floors))
        d = np.einsum("ij,jk,ik->i", x - c, p, x - c)
    assert np.allclose([got[f"c{i}"] for i in range(7)], c, atol=1e-6)
    assert np.allclose([got[f"p{i}_{j}"] for i in range(7) for j in range(i, 7)], [p[i, j] for i in range(7) for j in range(i, 7)], atol=1e-3)


def test_empty_table(spark, stored):
    assert m.judge(stored([])).count() == 0
