"""Bootstrap and permutation by sums a task, against resampling row by row."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import resampling as R


def halves(key):
    d = hashlib.md5(str(key).encode()).hexdigest()
    return int(d[:8], 16), int(d[8:16], 16)


def mix(x):
    x ^= x >> 16
    x = x * 0x85EBCA6B % 2**32
    x ^= x >> 13
    x = x * 0xC2B2AE35 % 2**32
    return x ^ x >> 16


def times(key, b, seed):
    high, low = halves(key)
    h = mix(mix(high ^ mix((b * 1000003 + seed) % 2**32)) ^ low)
    return sum(h >= t for t in R.POISSON)


def auroc(rows, w):
    pos, neg = [(p, v) for (_, y, p), v in zip(rows, w) if y == 1], [(p, v) for (_, y, p), v in zip(rows, w) if y != 1]
    total = sum(v for _, v in pos) * sum(v for _, v in neg)
    return sum(a * b * ((p > q) + (p == q) / 2) for p, a in pos for q, b in neg) / total if total else None


def test_weights_are_poisson():
    h = np.random.default_rng(1).integers(0, 2**32, (2, 3000))
    w = R.weights(h[0], h[1], 50, 7)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.01
    assert abs(np.corrcoef(w.T)[np.triu_indices(50, 1)]).max() < 0.1  # resamples are independent of each other
    assert all(w[k, b] == times_of(h[0][k], h[1][k], b) for k in range(20) for b in range(5))


def times_of(high, low, b):
    h = mix(mix(int(high) ^ mix((b * 1000003 + 7) % 2**32)) ^ int(low))
    return sum(h >= t for t in R.POISSON)


@pytest.mark.parametrize("parts", [1, 5])
def test_auroc_against_resampling_rows(spark, monkeypatch, parts):
    monkeypatch.setattr(R, "CHUNK", 16)
    r = np.random.default_rng(3)
    rows = [(k, int(r.random() < 0.4), float(np.round(r.random(), 2))) for k in range(150)]
    rows += [(1000 + k, k % 3 == 0, 0.5) for k in range(100)] + [(2000 + k, k % 2, p) for k, p in enumerate((0.0, 1.0, 1.0, 0.0, 0.0004, 0.0009))]
    rows = [(k, int(y), p) for k, y, p in rows]
    table = spark.createDataFrame([*rows, (9, 1, None)], "k long, y_true int, y_prob double").repartition(parts)
    values = [auroc(rows, [times(k, b, 4) for k, _, _ in rows]) for b in range(40)]
    got = R.bootstrap_auroc(table, "k", 40, 4).first()
    assert np.isclose(got["mean"], np.mean(values)) and np.isclose(got["lo"], np.quantile(values, 0.025)) and np.isclose(got["hi"], np.quantile(values, 0.975)) and got["n_defined"] == 40
    one = R.bootstrap_auroc(table.where("y_true = 1"), "k", 5, 4).first()
    assert one["mean"] is None and one["n_defined"] == 0
    assert R.bootstrap_auroc(table.where("false"), "k", 5, 4).first()["n_defined"] == 0


def test_means_against_resampling_rows_and_the_multinomial(spark, monkeypatch):
    monkeypatch.setattr(R, "GROUPS", 2)
    r = np.random.default_rng(5)
    rows = [(k, f"g{k % 5}" if k % 7 else None, float(r.normal() + k % 5)) for k in range(200)] + [(900, "few", 1.0), (901, "few", 2.0)]
    table = spark.createDataFrame(rows, "k long, g string, v double").repartition(4)
    got = {x["g"]: x for x in R.grouped_bootstrap(table, "k", F.col("v"), "g", 300, 2).collect()}
    assert got.keys() == {"g0", "g1", "g2", "g3", "g4", "few"} and got["few"]["status"] == "not_evaluable" and got["few"]["lo"] is None
    own = [(k, v) for k, g, v in rows if g == "g1"]
    means = [np.average([v for _, v in own], weights=[times(k, b, 2) for k, _ in own]) for b in range(300)]
    assert np.isclose(got["g1"]["lo"], np.quantile(means, 0.025)) and np.isclose(got["g1"]["hi"], np.quantile(means, 0.975)) and np.isclose(got["g1"]["estimate"], np.mean([v for _, v in own]))
    whole, values = R.bootstrap_mean(table, "k", "v", 2000, 1).first(), np.array([v for *_, v in rows])
    drawn = np.quantile([r.choice(values, len(values)).mean() for _ in range(2000)], [0.025, 0.975])
    assert np.allclose([whole["lo"], whole["hi"]], drawn, atol=0.05)


@pytest.mark.parametrize("block", [4096, 40])
def test_permutations_against_numpy(spark, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK", block)
    r = np.random.default_rng(6)
    rows = [(k, float(x), float(x * 0.15 + r.normal())) for k, x in enumerate(r.normal(size=130))]
    got = R.permutation_null(spark.createDataFrame([*rows, (500, None, 1.0)], "k long, x double, y double").repartition(3), "k", "x", "y", 60, 9).first()
    blocks, x, y = -(-len(rows) // block), np.array([v[1] for v in rows]), np.array([v[2] for v in rows])
    high, low = (np.array([halves(v[0])[i] for v in rows]) for i in range(2))
    hits = 0
    for b in range(60):
        dealt = np.zeros(len(rows))
        for k in range(blocks):
            at = np.flatnonzero(low % blocks == k)
            at = at[np.argsort(high[at], kind="stable")]
            h = np.array([mix(mix(int(high[i]) ^ mix((b * 1000003 + 9) % 2**32)) ^ int(low[i])) for i in at])
            dealt[at] = y[at[np.argsort(h, kind="stable")]]
        assert sorted(dealt) == sorted(y)
        hits += abs(np.corrcoef(x, dealt)[0, 1]) >= abs(np.corrcoef(x, y)[0, 1])
    assert np.isclose(got["r"], np.corrcoef(x, y)[0, 1]) and np.isclose(got["p_value"], hits / 60)


def test_no_spread_is_undefined(spark):
    table = spark.createDataFrame([(k, 1.0, float(k)) for k in range(5)], "k long, x double, y double")
    assert tuple(R.permutation_null(table, "k", "x", "y", 5, 1).first()) == (None, None)
