import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from driftline.functions.dialect import DUCKDB
from driftline.operators import selection
from driftline.sources import series


def test_series_io(spark, tmp_path):
    rows = [(i, t, float(t), int(t > 3)) for i in (1, 2) for t in range(8)] + [(3, 0, 1.0, 0)]
    for k, part in enumerate((rows[:10], rows[10:])):
        spark.createDataFrame(part, series.SERIES_SCHEMA).write.parquet(f"{tmp_path}/p{k}")
    series.rewrite_parts(spark, [f"{tmp_path}/p0", f"{tmp_path}/p1"], f"{tmp_path}/all")
    whole, short = series.complete_ids(series.read_series(spark, f"{tmp_path}/all"))
    assert whole.count() == 16 and [r.id for r in short.collect()] == [3]
    series.write_ids(whole.select("id").distinct(), f"{tmp_path}/ids")
    assert sorted(r.id for r in series.read_ids(spark, f"{tmp_path}/ids").collect()) == [1, 2]


def test_non_finite(spark):
    df = spark.createDataFrame([(1, 0, float("nan")), (1, 1, None), (1, 2, float("inf")), (1, 3, 0.0)], "id long, time int, v double")
    assert sorted(r.time for r in series.non_finite(df).collect()) == [0, 1, 2]


def test_auc_forms_agree(spark):
    rng = random.Random(5)
    rows = [(i, float(rng.randrange(6)), rng.random(), None if i % 9 == 0 else float(i % 2)) for i in range(200)]
    f = spark.createDataFrame(rows, "id long, a double, b double, c double")
    y = f.selectExpr("id", "cast(id % 2 as int) label")
    got = {r.feature: r.auc for r in selection.univariate_auc(f, y, ["a", "b", "c"]).collect()}
    con = duckdb.connect()
    con.register("f", f.toPandas())
    con.register("y", y.toPandas())
    want = dict(con.execute("WITH " + ",".join(selection.auc_sql(["a", "b", "c"])) + " SELECT feature, auc FROM auc").fetchall())
    assert got == pytest.approx(want) and got["c"] == 1.0
    wins = [(p[1] > n[1]) + 0.5 * (p[1] == n[1]) for p in rows if p[0] % 2 for n in rows if n[0] % 2 == 0]
    assert got["a"] == pytest.approx(sum(wins) / len(wins))
    one_class = y.selectExpr("id", "1 label")
    assert {r.auc for r in selection.univariate_auc(f, one_class, ["a"]).collect()} == {0.5}


def test_auc_over_many_ranges(spark):
    """Ranks must be right where a feature's values lie in several sorted ranges."""
    rng = random.Random(8)
    rows = [(i, rng.gauss(i % 2, 2.0), float(rng.randrange(50))) for i in range(3000)]
    f = spark.createDataFrame(rows, "id long, a double, b double").repartition(3)
    y = f.selectExpr("id", "cast(id % 2 as int) label")
    got = {r.feature: r.auc for r in selection.univariate_auc(f, y, ["a", "b"]).collect()}
    for k, c in enumerate("ab"):
        order = sorted((r[k + 1], r[0] % 2) for r in rows)
        below = won = i = 0
        while i < len(order):
            j = i
            while j < len(order) and order[j][0] == order[i][0]:
                j += 1
            ones = sum(x[1] for x in order[i:j])
            won += ones * (below + (j - i - ones) / 2)
            below += j - i - ones
            i = j
        assert got[c] == pytest.approx(won / (1500 * 1500))


def test_correlations_with_gaps(spark):
    rng = np.random.default_rng(2)
    data = pd.DataFrame(rng.normal(1e6, 1, (400, 4)), columns=list("abcd"))
    data["b"] += data["a"]
    data.loc[::7, "c"] = np.nan
    data["e"] = 3.0
    data.insert(0, "id", range(400))
    f = spark.createDataFrame(data).repartition(5)
    got = {(r.f1, r.f2): r["corr"] for r in selection.correlations(f, list("edcba")).collect()}
    want = data.drop(columns="id").corr()
    assert len(got) == 10
    for (x, y), v in got.items():
        assert (v is None) if "e" in (x, y) else v == pytest.approx(want.loc[x, y], abs=1e-9)
    assert selection.correlations(f, ["a"]).count() == 0
    empty = selection.correlations(f.limit(0), ["a", "b"]).collect()
    assert [(r.f1, r.f2, r["corr"]) for r in empty] in ([], [("a", "b", None)])


def test_scaling(spark):
    f = spark.createDataFrame([(i, float(i), 7.0, float(i)) for i in range(5)], "id long, x double, y double, x_logit double")
    fitted = selection.fit_scale(f, ["x", "y", "x_logit"])
    got = selection.scale(f, fitted).orderBy("id").collect()
    assert set(fitted) == {"x", "y"} and [round(r.x, 6) for r in got] == [-1.414214, -0.707107, 0.0, 0.707107, 1.414214]
    assert [r.y for r in got] == [0.0] * 5 and [r.x_logit for r in got] == [0.0, 1.0, 2.0, 3.0, 4.0]
    with pytest.raises(Exception, match="x"):
        selection.scale(f.drop("x"), fitted).collect()


def test_columns_ids_and_holdout(spark, tmp_path):
    df = spark.createDataFrame([(i, "t", float(i), i % 2) for i in range(1000)], "id long, name string, v double, label int")
    assert series.numeric_columns(df) == ["id", "v", "label"]
    assert series.without_ids(df, [3, 4]).count() == 998
    held = series.holdout_split(df).collect()
    assert len(held) == 1000 and [sum(r.held for r in held if r.label == k) for k in (0, 1)] == [20, 20]
    assert {r.id for r in held if r.held} == {r.id for r in series.holdout_split(df.repartition(7)).collect() if r.held}
    series.write_predictions(df.selectExpr("id", "v prediction"), f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").dtypes == [("id", "bigint"), ("prediction", "float")]
    wide = df.selectExpr("id", "1 time", "0 period", "v standardized", "v detrended", "name")
    series.write_essential(wide, f"{tmp_path}/e")
    assert spark.read.parquet(f"{tmp_path}/e").columns == series.ESSENTIAL


def test_selection_and_pruning(spark):
    auc = spark.createDataFrame([("a", 0.9), ("b", 0.1), ("c", 0.51), ("d", 0.6)], "feature string, auc double")
    assert selection.selected(auc, k=3) == ["a", "b", "d"] and selection.selected(auc, k=1, always=("z",)) == ["z", "a"]
    assert selection.excluded(["x_logit", "y"], selection.PLAIN) == ["y"]
    f = spark.createDataFrame([(i, float(i), float(-i), float(i % 3)) for i in range(30)], "id long, p double, q double, r double")
    corr = selection.correlations(f, ["p", "q", "r"])
    assert {(r.f1, r.f2) for r in corr.collect()} == {("p", "q"), ("p", "r"), ("q", "r")} and selection.pruned(corr) == ["q"]
    assert [(r.f1, r.f2) for r in selection.correlated(corr, 0.02).collect()][0] == ("p", "q")


def test_stream_scores_each_file(spark, tmp_path):
    from driftline.streaming.scoring import score_stream

    for k in range(3):
        spark.createDataFrame([(k, t, float(t), int(t > 2)) for t in range(6)], series.SERIES_SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    predict = lambda raw: raw.groupBy("id").avg("value").toDF("id", "prediction")
    for _ in range(2):  # the second run finds nothing new
        score_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", predict, 1).awaitTermination()
    assert sorted((r.id, r.prediction) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(0, 2.5), (1, 2.5), (2, 2.5)]


def test_oracles_parse():
    from driftline.plans import catalog

    queries, oracles = catalog.queries(), catalog.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 50 and len(catalog.COLUMNS) == 182
    assert DUCKDB.name != "spark" and all("{" not in s for s in oracles.values())
