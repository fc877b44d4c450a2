"""The boosting kernel, the many fits, what they store, and inference from raw series."""

import numpy as np
import pytest

from driftline.operators import boosting, cluster, learning
from driftline.sources import series

SMALL = {"shape": "level", "trees": 30, "rate": 0.3, "depth": 2, "l2": 1.0, "rows": 0.8, "tree_columns": 0.8}


def data(n=200, seed=1, spread=0.8):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 2
    x = rng.normal(0, 1, (n, 5))
    x[:, 1] += y * 1.2 / spread
    x[:, 3] -= y * 0.8 / spread
    return x, y


def frame(spark, n=160):
    x, y = data(n)
    return spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(n)], "id long, label int, a double, b double, c double, d double, e double")


def test_auc_by_pairs():
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 60), rng.integers(0, 9, 60)
    wins = [(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]]
    assert boosting.auc(y, s) == pytest.approx(np.mean(wins)) and boosting.auc(np.ones(3), s[:3]) == 0.5


def test_first_split_is_the_best_of_all():
    x, y = data(80)
    params = {"shape": "level", "trees": 1, "rate": 1.0, "depth": 1, "l2": 2.0, "l1": 0.3, "child_rows": 5}
    trees, _ = boosting.boost(x, y, params, 1)
    g, h = 0.5 - y, np.full(80, 0.25)
    score = lambda at: max(abs(g[at].sum()) - 0.3, 0) ** 2 / (h[at].sum() + 2)
    cuts = [(c, t) for c in range(5) for t in boosting.edges_of(x[:, c])]
    gains = {k: score(x[:, k[0]] <= k[1]) + score(x[:, k[0]] > k[1]) for k in cuts if 5 <= (x[:, k[0]] <= k[1]).sum() <= 75}
    best = max(gains, key=gains.get)
    assert (trees.column[0, 0], trees.threshold[0, 0]) == (best[0], pytest.approx(best[1]))
    left = x[:, best[0]] <= best[1]
    want = -np.sign(g[left].sum()) * max(abs(g[left].sum()) - 0.3, 0) / (h[left].sum() + 2)
    assert trees.value[0, 1] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("family", list(learning.FAMILIES))
def test_shapes_learn_and_stop(family):
    x, y = data(400)
    params = learning.FAMILIES[family] | {"child_weight": 2.0, "child_rows": 5, "least_gain": 0.0, "l2": 1.0, "rate": 0.2, "trees": 120}
    held = x[300:], y[300:]
    trees, aucs = boosting.boost(x[:300], y[:300], params, 4, held, 15)
    assert len(trees.column) == int(np.argmax(aucs)) + 1 and max(aucs) > 0.8
    assert len(aucs) == 120 or len(aucs) - len(trees.column) == 15
    assert boosting.auc(held[1], trees.margin(held[0])) == pytest.approx(max(aucs))
    again, _ = boosting.boost(x[:300], y[:300], params, 4, held, 15)
    assert np.array_equal(again.value, trees.value)
    if params["shape"] == "even":
        level = trees.column[:, 1:3]
        assert all(len({c for c in row if c >= 0}) <= 1 for row in level)
    if params["shape"] == "leaf":
        few, _ = boosting.boost(x[:300], y[:300], params | {"leaves": 3, "trees": 5}, 4)
        assert ((few.column >= 0).sum(1) <= 2).all()


def test_awkward_matrices():
    x, y = data(60)
    x[::5, 0], x[1, 2], x[:, 4] = np.nan, np.inf, 3.0
    steps = {"top": None, "least_auc": 0.5, "plain": ()}
    model = boosting.fit(x, y, list("abcde"), SMALL, 1, steps)
    assert np.isfinite(model.predict(x)).all()
    one = boosting.fit(x, np.ones(60), list("abcde"), SMALL, 1, steps)
    assert boosting.n_trees(one) == 0 and np.allclose(one.predict(x), one.predict(x)[0])
    again = boosting.Model.load(model.dump())
    assert np.array_equal(again.predict(x), model.predict(x)) and again.params == SMALL
    nothing = boosting.fit(x[:0], y[:0], list("abcde"), SMALL, 1, {"top": 2, "least_auc": 0.52, "plain": ()})
    assert nothing.predict(x).shape == (60,)


def test_steps_keep_and_scale():
    x, y = data(300)
    found = boosting.fit_steps(x, y, ["a", "b_logit", "c", "d", "e"], 3, 0.6, ("logit",), ("e",))
    assert list(found.kept) == [4, 1, 3]  # always kept first, then by AUC, the others are below the least
    assert found.spread[1] == 1.0 and found.centre[1] == 0.0
    z = found.transform(x)
    assert np.allclose(z[:, [0, 2]].mean(0), 0) and np.allclose(z[:, [0, 2]].std(0), 1)


def test_folds_agree_and_are_even(spark):
    rows = [(i * 7919 - 40_000, int(i % 3 == 0)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, label int").repartition(5)
    got = {r.id: r.fold for r in learning.with_folds(df, 5, 86).collect()}
    ids, y = (np.array(c) for c in zip(*rows, strict=True))
    assert [got[i] for i in ids.tolist()] == boosting.folds_of(ids, y, 5, 86).tolist()
    for label in (0, 1):
        sizes = np.bincount([got[i] for i, k in rows if k == label])
        assert sizes.max() - sizes.min() <= 1


def test_held_out_rows_teach_nothing_but_when_to_stop():
    x, y = data(120)
    ids = np.arange(120)
    job = {"fold": 1, "folds": 3, "seed": 5, "params": SMALL, "search": {}, "trials": 0, "inner_folds": 3, "inner_stop": 1, "patience": None, "steps": {"top": 3, "least_auc": 0.5, "plain": ()}}
    first = learning.fit_job(ids, x, y, list("abcde"), job)
    held = first["rows"]
    assert np.array_equal(held, np.flatnonzero(boosting.folds_of(ids, y, 3, 5) == 1))
    other = x.copy()
    other[held] = 99.0
    assert learning.fit_job(ids, other, y, list("abcde"), job)["model"] == first["model"]


CONFIG = learning.Config(families={"xgb_lite": SMALL, "cat_main": SMALL | {"shape": "even"}}, search={"xgb_lite": {"rate": (0.1, 0.5, True), "depth": (1, 3, False)}}, meta=SMALL | {"trees": 10}, folds=3, trials=2, patience=5, seeds=3, top_seeds=2)


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stack"))
    rows = frame(spark).cache()
    return rows, learning.train(rows, list("abcde"), CONFIG, path), path


def test_stack(spark, trained):
    rows, stack, _ = trained
    assert [b.family for b in stack.bases] == ["xgb_lite", "cat_main"]
    for i, b in enumerate(stack.bases):
        assert [s.seed for s in b.all] == learning.seed_list(69 + 100 * (i + 1), 3)
        assert [s.seed for s in b.top] == [s.seed for s in sorted(b.all, key=lambda s: (-s.auc, s.seed))[:2]]
        each = [{r.id: r.p for r in s.oof.collect()} for s in b.top]
        assert all(len(e) == 160 for e in each)
        assert all(r.p == pytest.approx((each[0][r.id] + each[1][r.id]) / 2) for r in b.oof.collect())
        assert b.top[0].auc > 0.75 and all(len(s.metrics) == 3 and len(s.folds) == 3 for s in b.all)
    assert [s.seed for s in stack.meta.all] == learning.seed_list(69 + 2000, 3)
    assert learning.auc(stack.oof.join(rows.select("id", "label"), "id")) > 0.75
    assert stack.bases[0].all[0].metrics[0]["tried"] and 0.1 <= stack.bases[0].all[0].full_params["rate"] <= 0.5


def test_inference_averages_folds_and_seeds(spark, trained):
    rows, stack, _ = trained
    with pytest.raises(ValueError):
        learning.infer(stack, rows, "other")
    x = np.array([[r.a, r.b, r.c, r.d, r.e] for r in rows.orderBy("id").collect()])
    for mode in ("full", "fold"):
        got = {r.id: r.prediction for r in learning.infer(stack, rows, mode).collect()}
        said = []
        for b in stack.bases:
            parts = [[s.full] if mode == "full" else s.folds for s in b.top]
            said.append(np.mean([np.mean([boosting.Model.load(m).predict(x) for m in p], 0) for p in parts], 0))
        p = np.clip(np.array(said).T, 1e-5, 1 - 1e-5)
        logits = np.log(p / (1 - p))
        stacked = np.column_stack([logits, logits.mean(1), logits.std(1, ddof=1)])
        want = np.mean([boosting.Model.load(s.full).predict(stacked) for s in stack.meta.top], 0)
        assert np.allclose([got[i] for i in range(160)], want)


def test_what_is_stored(spark, trained, monkeypatch):
    rows, stack, path = trained
    own = learning.signature(rows, list("abcde"), CONFIG)
    where = f"{path}/{own}/xgb_lite"
    seeds, mean = learning.read_summary(spark, where)
    assert [s for s, _, _ in seeds] == [169, 186, 203] and mean == pytest.approx(np.mean([s.auc for s in stack.bases[0].top]), abs=1e-6)
    assert {d for _, _, d in seeds} == {"xgb_lite_169", "xgb_lite_186", "xgb_lite_203"}
    assert spark.read.json(f"{where}/hp").count() == 3 * 4 and spark.read.json(f"{where}/metrics").count() == 9
    assert spark.read.parquet(f"{where}/oof").count() == 3 * 160 and spark.read.json(f"{where}/whole").first().type == "xgb_lite"
    loaded = learning.load(spark, where)
    assert [s.full for s in loaded.top] == [s.full for s in stack.bases[0].top] and loaded.top[0].full_params == stack.bases[0].top[0].full_params
    monkeypatch.setattr(learning, "train_seeds", lambda *a, **k: pytest.fail("trained again"))
    again = learning.train(rows, list("abcde"), CONFIG, path)
    assert {r.id: r.p for r in again.oof.collect()} == {r.id: r.p for r in stack.oof.collect()}
    changed = learning.signature(rows.filter("id > 0"), list("abcde"), CONFIG)
    assert own not in (changed, learning.signature(rows, list("abcd"), CONFIG), learning.signature(rows, list("abcde"), learning.Config()))


def test_fits_over_the_cluster(spark, tmp_path):
    """Beyond the bound of a task the same job runs on pyspark.ml."""
    rows = frame(spark, 60)
    config = learning.Config(families={"xgb_lite": {"trees": 2, "rate": 0.3, "depth": 2, "shape": "level"}}, search={"xgb_lite": {"rate": (0.2, 0.5, True)}}, meta={"trees": 1, "rate": 0.3, "depth": 1, "shape": "level"}, folds=2, trials=1, patience=1, seeds=1, top_seeds=1, top=3, inner_folds=2)
    stack = learning.train(rows, list("abcde"), config, str(tmp_path), task_bytes=0)
    assert not isinstance(stack.bases[0].top[0].full, bytes)
    assert stack.oof.count() == 60 and learning.infer(stack, rows.drop("label")).count() == 60
    assert cluster.stop_at([5, 4, 3, 4, 3, 3, 1], 3) == (3, True) and cluster.stop_at([3, 2, 1, 2], 3) == (3, False)


def test_parameters():
    assert learning.seed_list(69, 3) == [69, 86, 103]
    assert learning.consensus([{"a": 1, "b": "x", "c": True}, {"a": 3, "b": "y", "c": True}, {"a": 2, "b": "y", "c": False}]) == {"a": 2, "b": "y", "c": True}
    folds = [{"params": {"rate": r, "trees": 9}, "trees": t, "val_auc": v} for r, t, v in ((0.1, 10, 0.6), (0.3, 30, 0.9), (0.2, 20, 0.7))]
    finals = {how: learning.refit_params(learning.Config(refit=how), {"rate": 0.5, "trees": 9}, folds) for how in ("consensus", "best", "defaults")}
    assert finals == {"consensus": {"rate": 0.2, "trees": 20}, "best": {"rate": 0.3, "trees": 20}, "defaults": {"rate": 0.5, "trees": 20}}
    rng = np.random.default_rng(1)
    for family, ranges in learning.SEARCH.items():
        for _ in range(20):
            drawn = boosting.sampled(learning.FAMILIES[family], ranges, rng)
            assert set(drawn) == set(learning.FAMILIES[family])
            assert all(low <= drawn[k] <= high and isinstance(drawn[k], type(learning.FAMILIES[family][k])) for k, (low, high, _) in ranges.items())
    assert all(p["trees"] >= 1800 for p in learning.FAMILIES.values())


def test_learner_queries_do_the_whole_job(monkeypatch):
    from driftline.plans import catalog

    calls = []
    monkeypatch.setattr(catalog, "_rows", lambda spark, sf_dir: ("rows", ["a", "b"]))
    monkeypatch.setattr(catalog, "shared_folder", lambda spark: "there")
    monkeypatch.setattr(learning, "train", lambda *a: calls.append(a) or learning.Stack([], learning.Seeds("meta", [], [], None)))
    monkeypatch.setattr(learning, "infer", lambda *a: None)
    for q in ("meta_oof", "infer_full", "infer_fold"):
        catalog.queries()[q](None, "")
    assert calls == [("rows", ["a", "b"], learning.Config(), "there/driftline-stack")] * 3


def test_raw_series_to_predictions(spark, tmp_path):
    """As a stream of files, the same predictions as from features built at once."""
    from driftline.operators.features import forget, series_features
    from driftline.streaming.scoring import score_series

    tables = lambda: {t.name for t in spark.catalog.listTables()}
    before, rng = tables(), np.random.default_rng(6)
    rows = [(i, t, float(rng.normal(0, 1 + (i % 2) * (t >= 45))), int(t >= 45)) for i in range(12) for t in range(90)] + [(50, 0, 1.0, 0)]
    raw = spark.createDataFrame(rows, series.SERIES_SCHEMA).cache()
    features = series_features(raw, "testkey")
    columns = [c for c in features.columns if c != "id"]
    assert features.count() == 12 and len(columns) == 185
    config = learning.Config(families={"xgb_lite": SMALL | {"trees": 3}}, search={}, meta=SMALL | {"trees": 2}, folds=2, trials=0, patience=2, seeds=1, top_seeds=1)
    stack = learning.train(features.join(raw.selectExpr("id", "cast(id % 2 as int) label").distinct(), "id"), columns, config)
    want = {r.id: r.prediction for r in learning.infer(stack, features).collect()}
    forget(spark, "testkey")
    raw.coalesce(1).write.parquet(f"{tmp_path}/in")
    score_series(spark, stack, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", files_per_batch=1).awaitTermination()
    streamed = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {r.id: r.prediction for r in streamed} == pytest.approx(want) and {r.batch_id for r in streamed} == {0}
    assert tables() == before


def test_many_thousand_ids_are_fitted_by_tasks(monkeypatch):
    """60 times the ids of sf0.1 fit a task; one job after the other over the cluster does not end."""

    class Rows:
        def count(self):
            return 90_000

    monkeypatch.setattr(learning, "Tasks", lambda rows, columns: "tasks")
    monkeypatch.setattr(learning, "Cluster", lambda rows, columns: "cluster")
    assert learning.engine(Rows(), ["c"] * 185) == "tasks" and learning.engine(Rows(), ["c"] * 1850) == "cluster"


def test_bases_are_fitted_by_tasks_at_any_size(spark, monkeypatch):
    """On broadcast columns, with the models of a matrix in memory; the number of rows is not looked at."""
    x, y = data(80)
    x[::9, 2], x[3, 0] = np.nan, np.inf
    rows = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(80)], "id long, label int, a double, b double, c double, d double, e double").repartition(3)
    monkeypatch.setattr(learning, "engine", lambda *a: pytest.fail("chosen by size"))
    monkeypatch.setattr(learning, "GROUP", 2)
    config = learning.Config(families={"xgb_lite": SMALL | {"trees": 4}}, search={"xgb_lite": {"rate": (0.1, 0.5, True)}}, folds=2, trials=1, patience=2, seeds=1, top_seeds=1, top=3)
    found = learning.train_bases(rows, list("abcde"), config)[0].top[0]
    job = {"fold": 1, "folds": 2, "seed": 169, "params": SMALL | {"trees": 4}, "search": config.search["xgb_lite"], "trials": 1, "inner_folds": 5, "inner_stop": 1, "patience": 2, "steps": config.steps()}
    want = learning.fit_job(np.arange(80), x, y, list("abcde"), job)
    refit = learning.fit_job(np.arange(80), x, y, list("abcde"), job | {"fold": None, "params": found.full_params})
    assert found.folds[1] == want["model"] and found.full == refit["model"]
    assert {r.id: r.p for r in found.oof.filter("fold = 1").collect()} == dict(zip(want["rows"].tolist(), want["p"].tolist(), strict=True))


def test_the_learner_on_top_is_fitted_by_tasks_at_any_size(spark, monkeypatch):
    monkeypatch.setattr(learning, "engine", lambda *a: pytest.fail("chosen by size"))
    rng = np.random.default_rng(2)
    oof = spark.createDataFrame([(i, float(p)) for i, p in enumerate(rng.random(60) * 0.5 + np.arange(60) % 2 * 0.4)], "id long, p double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "id long, label int")
    config = learning.Config(meta=SMALL | {"trees": 3}, folds=2, seeds=1, top_seeds=1)
    found = learning.train_meta([learning.Seeds("xgb_lite", [], [], oof)], labels, config)
    assert isinstance(found.top[0].full, bytes) and found.oof.count() == 60 and found.top[0].auc > 0.7


def test_tries_share_selection_and_bins(monkeypatch):
    x, y = data(150)
    calls, plain = [], boosting.fit_steps
    monkeypatch.setattr(boosting, "fit_steps", lambda *a, **k: calls.append(1) or plain(*a, **k))
    ranges = {"rate": (0.1, 0.5, True)}
    steps = {"top": 3, "least_auc": 0.5, "plain": ()}
    best, found = boosting.tuned(np.arange(150), x, y, list("abcde"), SMALL, ranges, 3, 4, 3, 2, 5, steps)
    assert len(calls) == 2 and len(found) == 5  # two inner folds, five tries
    rng, at, said = np.random.default_rng(3), boosting.folds_of(np.arange(150), y, 3, 3), []
    for params in [SMALL, *(boosting.sampled(SMALL, ranges, rng) for _ in range(4))]:
        each = [boosting.fit(x[at != k], y[at != k], list("abcde"), params, 3, steps, (x[at == k], y[at == k]), 5).predict(x[at == k]) for k in (0, 1)]
        said.append(boosting.auc(np.concatenate([y[at == 0], y[at == 1]]), np.concatenate(each)))
    assert found == said


def test_halves_of_a_leaf_add_up():
    """Sums of the larger half, as what is left of its parent, give the trees of sums over its own rows."""
    x, y = data(600)
    params = learning.FAMILIES["lgb_main"] | {"child_weight": 1.0, "child_rows": 3, "trees": 6, "random_cuts": False, "rows": 1.0, "tree_columns": 1.0, "least_gain": 0.0}
    trees, _ = boosting.boost(x, y, params, 2)
    edges, bins = boosting.binned(x)
    margin = np.full(600, trees.start)
    for column, threshold, value in zip(trees.column, trees.threshold, trees.value, strict=True):
        p, at = 1 / (1 + np.exp(-margin)), np.zeros(600, int)
        for node in np.flatnonzero(column >= 0):  # parents come before their halves
            rows, g, h = np.flatnonzero(at == node), p - y, p * (1 - p)
            score = lambda r: max(abs(g[r].sum()) - params["l1"], 0) ** 2 / (h[r].sum() + params["l2"])  # noqa: E731, B023
            gains = {}
            for c in range(5):
                for k, e in enumerate(edges[c]):
                    left, right = rows[bins[c, rows] <= k], rows[bins[c, rows] > k]
                    if min(len(left), len(right)) >= 3 and min(h[left].sum(), h[right].sum()) >= 1:
                        gains[c, k] = score(left) + score(right)
            mine = column[node], int(np.searchsorted(edges[column[node]], threshold[node]))
            assert gains[mine] == pytest.approx(max(gains.values()), rel=1e-9)
            at[rows] = 2 * node + 1 + (x[rows, column[node]] > threshold[node])
        margin += value[at]
