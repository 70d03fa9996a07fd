"""Batched logistic models against fitting one by one."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import lattice as L
from cohortloom.operators.cohorts import ContractError
from cohortloom.operators.splits import grouped_folds

PENALTIES = [1.0, 0.01, 0.1]


def alone(x, y, penalty):
    """A fitted model, by many steps on the rows themselves."""
    mean, dev = x.mean(axis=0), x.std(axis=0, ddof=1)
    dev = np.where(dev > 0, dev, 1)
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / dev])
    w = np.where(y == 1, len(y) / 2 / (y == 1).sum(), len(y) / 2 / (y == 0).sum())
    ridge, b = np.array([0.0] + [penalty] * x.shape[1]), np.zeros(x.shape[1] + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-z @ b))
        b = b - np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z / w.sum() + np.diag(ridge), z.T @ (w * (p - y)) / w.sum() + ridge * b)
    return lambda q: 1 / (1 + np.exp(-(np.hstack([np.ones((len(q), 1)), (q - mean) / dev]) @ b)))


def auroc(y, p):
    pairs = [(a > b) + (a == b) / 2 for a in p[y == 1] for b in p[y == 0]]
    return np.mean(pairs) if pairs else None


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(2)
    y = (r.random(60) < 0.4).astype(float)
    x = r.normal(size=(60, 3)) + y[:, None] * [0.8, 0.0, -0.4]
    x[:, 2] = np.round(x[:, 2])
    table = spark.createDataFrame([(f"s{k}", float(y[k]), x[k].tolist(), "extra") for k in range(60)], "subject_id string, y double, x array<double>, model string").repartition(3)
    folds = L.nested_folds(table.select("subject_id", F.col("y").alias("label")), 3, 3, 5)
    return x, y, table.join(folds, "subject_id"), {r["subject_id"]: (r["fold"], r["inner"]) for r in folds.collect()}


def test_inner_folds_leave_the_outer_out(spark, data):
    _, y, _, folds = data
    assert len(folds) == 60 and {f for f, _ in folds.values()} == {0, 1, 2}
    assert all([i is None for i in inner] == [o == fold for o in range(3)] for fold, inner in folds.values())
    table = spark.createDataFrame([(s, float(y[int(s[1:])])) for s, (f, _) in folds.items() if f != 1], "subject_id string, label double")
    assert {r["subject_id"]: r["fold"] for r in grouped_folds(table, 3, 5).collect()} == {s: inner[1] for s, (f, inner) in folds.items() if f != 1}


def test_lattice_against_models_one_by_one(data):
    x, y, rows, folds = data
    choices, predicted = L.nested_selection(rows, PENALTIES, 3, steps=20)
    got = {r["subject_id"]: r["y_prob"] for r in predicted.collect()}
    fold = np.array([folds[f"s{k}"][0] for k in range(60)])
    for r in choices.collect():
        o = r["outer"]
        inner = np.array([-1 if fold[k] == o else folds[f"s{k}"][1][o] for k in range(60)])
        means = []
        for p in PENALTIES:
            each = [auroc(y[inner == i], alone(x[(fold != o) & (inner != i)], y[(fold != o) & (inner != i)], p)(x[inner == i])) for i in range(3)]
            means.append(np.mean(each))
        assert np.isclose(r["inner_score"], max(means)) and r["penalty"] == PENALTIES[int(np.argmax(np.round(means, 12)))] and r["n_defined"] == 3
        p = alone(x[fold != o], y[fold != o], r["penalty"])(x[fold == o])
        assert np.isclose(r["auroc"], auroc(y[fold == o], p))
        assert np.allclose([got[f"s{k}"] for k in np.flatnonzero(fold == o)], p, atol=1e-7)


def test_held_out_rows_change_no_choice(data):
    _, _, rows, _ = data
    broken = rows.withColumn("x", F.when(F.col("fold") == 0, F.transform("x", lambda v: v * 1000 + 7)).otherwise(F.col("x"))).withColumn("y", F.when(F.col("fold") == 0, 1 - F.col("y")).otherwise(F.col("y")))
    first = lambda t: L.nested_selection(t, PENALTIES, 3, steps=3)[0].where("outer = 0").select("penalty", "inner_score").first()
    assert first(rows) == first(broken)


def test_jobs_do_not_grow_with_the_lattice(spark, data):
    _, _, rows, _ = data
    tracker = spark.sparkContext.statusTracker()

    def jobs(penalties):
        group = f"lattice-{len(penalties)}"
        spark.sparkContext.setJobGroup(group, group)
        L.nested_selection(rows, penalties, 3, steps=2)
        return len(tracker.getJobIdsForGroup(group))

    assert jobs([0.1]) == jobs([0.01, 0.1, 1.0, 10.0])


def test_undefined_folds_stay_undefined(spark):
    rows = spark.createDataFrame([(f"s{k}", float(k == 0), [float(k), 1.0], k % 2, [None, 0] if k % 2 == 0 else [k // 2 % 2, None]) for k in range(8)], "subject_id string, y double, x array<double>, fold int, inner array<int>")
    choices, predicted = L.nested_selection(rows, PENALTIES, 2)
    got = {r["outer"]: r for r in choices.collect()}
    assert all(r["inner_score"] is None and r["penalty"] == PENALTIES[0] and r["n_defined"] == 0 for r in got.values())
    assert got[0]["auroc"] is None and {r["fold"] for r in predicted.collect()} == {1}  # the model of fold 0 would train on one class
    with pytest.raises(ContractError):
        L.nested_selection(rows.where("false"), PENALTIES, 2)
    with pytest.raises(ContractError):
        L.newton(rows, [L.Cell(0, i, p) for i, p in itertools.product(range(100), range(100))], 500)


def test_folds_together_against_one_by_one(data):
    x, y, rows, folds = data
    got = {r["subject_id"]: r["y_prob"] for r in L.out_of_fold(rows.drop("inner"), 0.1, 3, steps=20).collect()}
    fold = np.array([folds[f"s{k}"][0] for k in range(60)])
    for o in range(3):
        assert np.allclose([got[f"s{k}"] for k in np.flatnonzero(fold == o)], alone(x[fold != o], y[fold != o], 0.1)(x[fold == o]), atol=1e-7)
    assert len(got) == 60


def test_arms_without_each_source(spark, data):
    x, y, rows, _ = data
    source = [f"src{k % 3}" for k in range(60)]
    table = rows.withColumn("source", F.concat(F.lit("src"), F.substring("subject_id", 2, 9).cast("int") % 3))
    got = {(r["arm"], r["source"]): r for r in L.held_out_sources(table, {"balanced": True, "unweighted": False}, 0.1, 3, steps=20).collect()}
    assert len(got) == 6
    for s in set(source):
        held = np.array([q == s for q in source])
        p = alone(x[~held], y[~held], 0.1)(x[held])
        r = got["balanced", s]
        assert r["n"] == held.sum() and np.isclose(r["auroc"], auroc(y[held], p)) and r["change"] == 0
        assert np.isclose(r["balanced_accuracy"], ((p >= 0.5)[y[held] == 1].mean() + (p < 0.5)[y[held] == 0].mean()) / 2)
        assert np.isclose(got["unweighted", s]["change"], got["unweighted", s]["balanced_accuracy"] - r["balanced_accuracy"])
    assert any(got["unweighted", s]["change"] != 0 for s in set(source))
    with pytest.raises(ContractError):
        L.held_out_sources(table.withColumn("source", F.lit("one")), {"a": True}, 0.1, 3)
