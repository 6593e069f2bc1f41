"""Composite operators on small cases worked out by hand or by numpy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, history, model
from tessera.operators import relational as rel
from tessera.sources.tables import Versions


def obs(spark, rows):
    return spark.createDataFrame([(k, dt.datetime(2026, 10, d), f"202610{d:02d}", h) for k, d, h in rows], "key string, seen_at timestamp, batch string, hash string")


def versions(df):
    return sorted((r["key"], r["valid_from"].day, r["hash"], r["version"], r["is_current"]) for r in df.collect())


def test_history_keeps_changes_and_returns(spark):
    h = history.history(obs(spark, [("x", 16, "A"), ("x", 18, "C"), ("x", 20, "A"), ("x", 23, "B"), ("x", 24, "A"), ("y", 16, "Q")]))
    assert versions(h) == [("x", 16, "A", 1, False), ("x", 18, "C", 2, False), ("x", 20, "A", 3, False), ("x", 23, "B", 4, False), ("x", 24, "A", 5, True), ("y", 16, "Q", 1, True)]


def test_sync_late_correction_deletion_and_no_change(spark, tmp_path):
    target, state = Versions(spark, f"{tmp_path}/h"), Versions(spark, f"{tmp_path}/s")
    rows = [("x", 16, "A"), ("x", 20, "A"), ("y", 16, "Q")]
    assert history.sync(obs(spark, rows), target, state) == "FULL_REBUILD"
    assert history.sync(obs(spark, rows), target, state) == "NO_CHANGE"
    late = [*rows, ("x", 18, "C")]
    assert history.sync(obs(spark, late), target, state) == "MERGE_AFFECTED_KEYS"
    assert rel.same_rows(target.read(), history.bucketed(history.history(obs(spark, late))).select(*target.read().columns))
    folders = [p for p, _ in target.state()['parts']]
    assert len(folders) == 2  # the first version's other folders stay where they are
    assert history.sync(obs(spark, late[:2]), target, state) == "MERGE_AFFECTED_KEYS"  # y is gone
    assert versions(target.read()) == [("x", 16, "A", 1, True)]
    assert len(versions(target.read(1))) == 2


def test_sync_rejects_bad_input(spark, tmp_path):
    target, state = Versions(spark, f"{tmp_path}/h"), Versions(spark, f"{tmp_path}/s")
    for rows in ([("x", 16, "A"), ("x", 16, "B")], [(None, 16, "A")]):
        with pytest.raises(ValueError):
            history.sync(obs(spark, rows), target, state)
    assert target.version == 0


def test_pareto_keeps_equal_rows(spark):
    d = spark.createDataFrame([(1, "g", 1.0, 5.0), (2, "g", 1.0, 5.0), (3, "g", 2.0, 4.0), (4, "g", 2.0, 9.0), (5, "h", 9.0, 1.0)], "id int, g string, price double, area double")
    assert sorted(r["id"] for r in rel.pareto(d, "id", ["g"], ["price"], ["area"]).collect()) == [1, 2, 4, 5]


def test_components(spark):
    e = spark.createDataFrame([(2, 3), (1, 2), (24, 25), (25, 26), (30, 26), (7, 7)], "a long, b long")
    assert {r["node"]: r["root"] for r in graph.components(e).collect()} == {1: 1, 2: 1, 3: 1, 24: 24, 25: 24, 26: 24, 30: 24}
    assert graph.components(e.limit(0)).count() == 0


def test_close_pairs_over_bin_edges(spark):
    rng = np.random.default_rng(1)
    x = np.exp(rng.uniform(0, 0.4, 120))
    d = spark.createDataFrame([(i, "a", float(v)) for i, v in enumerate(x)], "id int, g string, v double")
    got = {(r["l"], r["r"]) for r in rel.close_pairs(d, "id", ["g"], {"v": 0.03}).selectExpr("l.id AS l", "r.id AS r").collect()}
    assert got == {(i, j) for i in range(120) for j in range(i + 1, 120) if abs(x[i] - x[j]) <= 0.03 * max(x[i], x[j])}


def test_ridge_recovers_coefficients(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), str(a), str(b), float(1.0 + 0.5 * (a == 1) - 0.25 * (b == 2))) for i, (a, b) in enumerate(zip(rng.choice(3, 400, p=[0.5, 0.3, 0.2]), rng.choice(3, 400, p=[0.5, 0.3, 0.2]), strict=True))]
    d = model.terms(spark.createDataFrame(rows, "id int, a string, b string, y double"), ["a", "b"])
    beta = model.fit(d, "y", ridge=0.0)
    assert abs(beta["a=1"][0] - 0.5) < 1e-9 and abs(beta["b=2"][0] + 0.25) < 1e-9 and abs(beta[""][0] - 1) < 1e-9
    assert model.predict(d, beta).selectExpr("max(abs(predicted - y)) AS e").first()["e"] < 1e-9
    assert model.fit(d.limit(0), "y") == {}


def test_mann_whitney_by_brute_force(spark):
    a, b = [1, 2, 2, 5], [2, 3, 4]
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    counts = [(v, a.count(v), b.count(v)) for v in sorted(set(a + b))]
    assert float(model.mann_whitney(spark.createDataFrame(counts, "value int, n1 long, n2 long")).first()["u"]) == u


def test_fingerprint_ignores_order(spark):
    d = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, v string")
    assert rel.fingerprint(d).first() == rel.fingerprint(d.orderBy("v").repartition(3)).first() != rel.fingerprint(d.distinct()).first()


@pytest.mark.parametrize("ranked", [1_000_000, 5])
def test_quantiles_by_bins(spark, monkeypatch, ranked):
    monkeypatch.setattr(rel, "RANKED", ranked)
    monkeypatch.setattr(rel, "BINS", 4)
    rng = np.random.default_rng(5)
    groups = {"a": np.exp(rng.normal(0, 3, 400)), "b": np.repeat([1.0, 2.0], [70, 31]), "c": np.array([7.0]), None: rng.normal(size=50)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None), ("a", float("nan")), ("d", None)]
    got = {r["g"]: r["q"] for r in rel.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", (0.0, 0.1, 0.5, 0.9, 1.0)).collect()}
    assert got.keys() == groups.keys()
    for g, xs in groups.items():
        assert np.allclose(got[g], np.quantile(xs, (0.0, 0.1, 0.5, 0.9, 1.0)), rtol=1e-12)


def test_numbered(spark):
    d = spark.range(500).selectExpr("(id * 7919) % 500 AS k", "id % 3 AS x")
    assert all(r["place"] == r["k"] for r in rel.numbered(d, [F.col("k")]).collect())


def test_a_pointer_is_written_once(spark, tmp_path):
    v = Versions(spark, f"{tmp_path}/t")
    assert v.version == 0 and v.commit(spark.range(3).toDF("x"), a="1") == 1 and v.commit(spark.range(5).toDF("x"), b="2") == 2
    with pytest.raises(ValueError):
        v._point(2, {"version": 2})
    assert v.read().count() == 5 and v.read(1).count() == 3 and v.properties() == {"a": "1", "b": "2"}


def test_cross_validation_by_normal_equations(spark):
    """Coefficients of every fold and ridge against numpy on the rows themselves; predictions and errors follow."""
    rng = np.random.default_rng(8)
    rows = [(int(i), str(a), str(b), int(f), float(0.3 * a - 0.2 * b + rng.normal())) for i, (a, b, f) in enumerate(zip(rng.integers(0, 3, 300), rng.integers(0, 4, 300), rng.integers(0, 5, 300), strict=True))]
    d = model.terms(spark.createDataFrame(rows, "id int, a string, b string, fold int, y double"), ["a", "b"])
    got = model.fit_folds(d, "y", (5.0, 0.1))
    data = [(r["fold"], r["terms"], r["y"]) for r in d.collect()]
    names = sorted({t for _, ts, _ in data for t in ts} | {""})
    x = np.array([[1.0 if n == "" or n in ts else 0.0 for n in names] for _, ts, _ in data])
    y, fold = np.array([v for *_, v in data]), np.array([f for f, *_ in data])
    for f in range(5):
        for k, ridge in enumerate((5.0, 0.1)):
            a, b = x[fold != f], y[fold != f]
            want = np.linalg.solve(a.T @ a + np.diag([0.0 if n == "" else ridge for n in names]), a.T @ b)
            assert np.allclose([got[f][n][k] for n in names], want, atol=1e-9)
    p = model.predict_folds(d, got, 2).select("fold", "terms", "predictions").collect()
    assert all(abs(r["predictions"][0] - sum(got[r["fold"]][t][0] for t in ["", *r["terms"]])) < 1e-9 for r in p)


def test_choice_and_bootstrap():
    assert model.chosen([("a", 1.0), ("b", 0.9995), ("c", 0.99), ("d", 0.9895)]) == ("c", 0.99)
    same = model.paired_bootstrap([(1.0, 1.0, 5)] * 20)
    assert (same["difference"], same["low"], same["high"]) == (0.0, 0.0, 0.0)
    better = model.paired_bootstrap([(1.0 + 0.01 * k, 2.0, 10) for k in range(30)])
    assert better["high"] < 0 and better["not_larger"] == 1.0 and better["low"] <= better["difference"] <= better["high"]
