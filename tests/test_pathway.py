"""Two-level attention over modules and its source strategies, against numpy and finite differences."""

import itertools
from dataclasses import replace

import numpy as np
import pytest

from cohortloom.operators import invariance as I
from cohortloom.operators import pathway as W
from cohortloom.operators.cohorts import ContractError

GENES, SOURCES = 6, ["a", "b", "c"]
MEMBERS = [(0, 0), (0, 1), (0, 5), (1, 2), (1, 3), (2, 1), (2, 4)]


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(3)
    cells, outcomes = [], []
    for s in range(14):
        for _ in range(1 if s == 0 else int(r.integers(2, 9))):
            kind = [None, 0, 1, 2][int(r.integers(4))]
            cells.append((f"s{s}", kind, (r.normal(size=GENES) + s % 3 * 0.4).tolist()))
        outcomes.append((f"s{s}", None if s == 5 else float(s % 2), "c" if s == 13 else SOURCES[s % 2]))  # c has one subject
    table = spark.createDataFrame([(*c, 1.0) for c in cells], "subject_id string, cell_type_id int, x array<double>, norm double").repartition(3)
    known = spark.createDataFrame(outcomes, "subject_id string, y double, source string")
    return cells, outcomes, table, known


def start():
    model = W.PathwayAttention.start(GENES, MEMBERS, 2, SOURCES, seed=7)
    return model.with_flat(model.flat() + np.random.default_rng(1).normal(size=len(model.flat())) * 0.1)


def forward(cells, model):
    """z by subject, one subject after the other."""
    def pool(gate, h):
        s = gate.w @ (np.tanh(gate.v @ h.T) / (1 + np.exp(-gate.u @ h.T)))
        a = np.exp(s - s.max())
        return a / a.sum() @ h

    out = {}
    for s in sorted({c[0] for c in cells}):
        types = {}
        for subject, kind, x in cells:
            if subject == s:
                types.setdefault(kind, []).append(np.tanh(model.projection() @ np.array(x) + model.bias))
        out[s] = pool(model.type_gate, np.array([pool(model.cell_gate, np.array(h)) for h in types.values()]))
    return out


def losses(cells, outcomes, model, settings, bandwidth=None):
    """(task, penalty) as defined, pairs of subjects and all."""
    z = forward(cells, model)
    known = [(s, y, src) for s, y, src in outcomes if y is not None]
    sizes = {src: sum(k[2] == src for k in known) for _, _, src in known}
    task = 0.0
    for s, y, src in known:
        p = 1 / (1 + np.exp(-(model.c @ z[s] + model.b)))
        share = 1 / (len(sizes) * sizes[src]) if settings.strategy == "source_balanced" else 1 / len(known)
        task -= share * np.log(p if y == 1 else 1 - p)
    by = {src: np.array([z[s] for s, _, q in outcomes if q == src]) for src in SOURCES}
    pairs = list(itertools.combinations(SOURCES, 2))
    if settings.strategy == "coral":
        cov = {s: np.cov(x.T) if len(x) > 1 else np.zeros((3, 3)) for s, x in by.items()}
        return task, np.mean([((cov[i] - cov[j]) ** 2).sum() / 36 for i, j in pairs])
    if settings.strategy == "mmd":
        w = I.frequencies(settings.features, 3, settings.seed) / bandwidth
        kernel = lambda x, y: np.cos((x[:, None, :] - y[None, :, :]) @ w.T).mean(axis=2).mean()
        return task, np.mean([kernel(by[i], by[i]) + kernel(by[j], by[j]) - 2 * kernel(by[i], by[j]) for i, j in pairs])
    if settings.strategy == "domain_adversarial":
        each = []
        for s, _, src in outcomes:
            logits = model.head @ z[s] + model.head_bias
            each.append(np.log(np.exp(logits).sum()) - logits[SOURCES.index(src)])
        return task, np.mean(each)
    return task, 0.0


def slope(f, p, h=1e-5):
    return np.array([(f(p + h * e) - f(p - h * e)) / (2 * h) for e in np.eye(len(p))])


STRATEGIES = [I.Settings(), I.Settings("source_balanced"), I.Settings("coral", 5.0), I.Settings("mmd", 2.0, features=16), I.Settings("domain_adversarial", 0.7, reversal=0.6)]


@pytest.mark.parametrize("settings", STRATEGIES, ids=lambda s: s.strategy)
def test_gradients_against_finite_differences(data, settings):
    cells, outcomes, table, known = data
    model = start()
    step = W.gradient(table, known, model, settings)
    bandwidth = getattr(step.penalty, "bandwidth", None)
    if bandwidth:
        z = np.array(list(forward(cells, model).values()))
        assert np.isclose(bandwidth**2, np.mean([((a - b) ** 2).sum() for a, b in itertools.combinations(z, 2)]))
    task, extra = losses(cells, outcomes, model, settings, bandwidth)
    assert np.isclose(step.loss, task) and np.isclose(step.penalty.loss, extra, atol=1e-12)
    by_task, by_penalty = (slope(lambda p, k=k: losses(cells, outcomes, model.with_flat(p), settings, bandwidth)[k], model.flat()) for k in range(2))
    head = model.head.size + len(model.head_bias)
    sign = np.ones(len(by_task))
    if settings.strategy == "domain_adversarial":  # the head descends, all below it climbs
        sign[:-head] = -settings.reversal
    assert np.allclose(step.gradient, by_task + settings.weight * sign * by_penalty, atol=1e-7)
    assert np.abs(step.gradient).max() > 1e-3
    assert np.allclose(W.gradient(table.repartition(7), known, model, settings).gradient, step.gradient)


def test_forward_against_numpy(data):
    cells, _, table, _ = data
    model = start()
    got = {r["subject_id"]: r for r in W.subject_vectors(table, model).collect()}
    want = forward(cells, model)
    assert got.keys() == want.keys() and all(np.allclose(got[s]["z"], want[s]) for s in want)
    assert all(np.isclose(sum(r["attention"]), 1) and len(r["attention"]) == len({c[1] for c in cells if c[0] == s}) for s, r in got.items())


def test_masked_weights_stay_out_and_training_lowers_the_loss(data):
    _, _, table, known = data
    model, history = W.fit(table, known, start(), I.Settings("coral", 1.0, warmup=2), rounds=8, rate=0.1)
    assert history[-1]["loss"] < history[0]["loss"] and [h["penalty"] > 0 for h in history] == [False] * 2 + [True] * 6
    outside = np.ones((3, GENES), bool)
    for m, g in MEMBERS:
        outside[m, g] = False
    assert not model.projection()[outside].any() and model.projection()[~outside].all()


def test_an_alignment_penalty_brings_sources_closer(data):
    _, _, table, known = data
    known = known.where("source <> 'c'")
    model = replace(start(), sources=["a", "b"], head=np.zeros((2, 3)), head_bias=np.zeros(2))
    plain, _ = W.fit(table, known, model, rounds=6, rate=0.1)
    aligned, _ = W.fit(table, known, model, I.Settings("mmd", 20.0), rounds=6, rate=0.1)
    assert W.source_report(table, known, aligned)["mmd"] < W.source_report(table, known, plain)["mmd"]


def test_contracts(spark, data):
    _, _, table, known = data
    for broken in ({"strategy": "none"}, {"weight": -1.0}, {"warmup": -1}, {"reversal": -0.1}):
        with pytest.raises(ContractError):
            I.Settings(**broken)
    with pytest.raises(ContractError):
        W.PathwayAttention.start(GENES, [(0, 1), (2, 2)], 2)
    with pytest.raises(ContractError):
        W.PathwayAttention.start(GENES, [(0, GENES)], 2)
    with pytest.raises(ContractError):
        W.fit(table, known.where("source <> 'c'"), start(), I.Settings("coral", 1.0), rounds=1)
    with pytest.raises(ContractError):
        I.vocabulary(spark.createDataFrame([("a",), ("unknown",)], "source string"))
    with pytest.raises(ContractError):
        I.Adversary(known, ["a"], 3, np.zeros((1, 3)), np.zeros(1), 1.0)
    with pytest.raises(Exception, match="finite values"):
        W.subject_vectors(spark.createDataFrame([("s", 0, [1.0, 2.0])], "subject_id string, cell_type_id int, x array<double>"), start()).collect()
    with pytest.raises(Exception, match="not in the vocabulary"):
        W.gradient(table, known, replace(start(), sources=["a", "b", "x"]), I.Settings("coral", 1.0))


def test_sources_of_one_subject_and_empty_tables(spark, data):
    _, _, table, known = data
    lone = I.Coral(spark.createDataFrame([("a", [1.0, 2.0])], "source string, z array<double>"), ["a", "b"], 2)
    assert lone.loss == 0 and not lone.gradient(np.ones((1, 2)), np.array([0])).any()
    same = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 2.0])], "source string, z array<double>")
    assert I.Mmd(same, ["a", "b"], 2, 8, 0).loss == 0
    step = W.gradient(table.where("false"), known, start())
    assert step.loss == 0 and not step.gradient.any()


def test_strategies_side_by_side_equal_those_trained_alone(spark, data):
    _, _, table, known = data
    kept, context = (table.persist(), known.persist()), spark.sparkContext

    def jobs(name, run):
        context.setJobGroup(name, name)
        try:
            return run(), [context.statusTracker().getJobInfo(j) for j in context.statusTracker().getJobIdsForGroup(name)]
        finally:
            context.setJobGroup("", "")

    def together(strategies):
        with W.laid_out(table, known, GENES) as laid:
            return W.fit_strategies(laid, start(), strategies, 3, 0.1)

    settings = [replace(s, warmup=k % 2) for k, s in enumerate(STRATEGIES)]
    _, one = jobs("one", lambda: together([settings[0]]))
    got, all_ = jobs("all", lambda: together(settings))
    assert len(all_) < 2.5 * len(one)  # penalties have jobs of their own over subjects; passes over cells are shared
    for s, (model, history) in zip(settings, got, strict=True):
        alone, rounds = W.fit(table, known, start(), s, 3, 0.1)
        assert np.allclose(model.flat(), alone.flat()) and [(h["loss"], h["penalty"]) for h in history] == [pytest.approx((h["loss"], h["penalty"])) for h in rounds]
    for x in kept:
        x.unpersist()


def test_partitions_follow_the_cells_and_long_groups_are_cut(spark, data):
    """A pass over a few cells has a few tasks, whatever spark.sql.shuffle.partitions says; 600 like cells of one subject and type are three blocks. Representations are those of the plain pass."""
    _, _, table, known = data
    with W.laid_out(table, known, GENES) as laid:
        assert laid.blocks.rdd.getNumPartitions() == 1
    like = spark.createDataFrame([("s1", 0, [1.0] * GENES)] * 600 + [("s2", None, [0.5] * GENES)], "subject_id string, cell_type_id int, x array<double>").coalesce(1)
    with W.laid_out(like, known, GENES) as laid:
        assert sorted(len(r["x"]) // 8 // GENES for r in laid.blocks.collect()) == [1, 88, 256, 256] and laid.types == 2
    with W.laid_out(table, known, GENES) as laid:
        z = {r["subject_id"]: r["z"] for r in W._subjects(laid, [start(), start()]).collect()}
    assert all(np.allclose(z[r["subject_id"]], [*r["z"], *r["z"]]) for r in W.subject_vectors(table, start()).collect())


def test_values_that_are_missing_are_an_error_in_training(spark, data):
    known = data[3]
    for x in (None, [1.0, None, 1.0, 1.0, 1.0, 1.0], [1.0] * (GENES - 1), [float("nan")] * GENES):
        with pytest.raises(Exception, match="finite values"):
            W.gradient(spark.createDataFrame([("s1", 0, x)], "subject_id string, cell_type_id int, x array<double>"), known, start())
