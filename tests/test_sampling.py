"""Capped batches against drawing one cell after the other from lists."""

import collections
import hashlib
import random

import pytest

from cohortloom.operators import sampling as B
from cohortloom.operators.cohorts import ContractError

P = [("a", 0.5), ("b", 0.3), ("c", 0.2), ("d", 0.0)]


def rows():
    r = random.Random(6)
    out, n = [], 0
    for c, subjects in (("a", 2), ("b", 5), ("c", 9)):
        for s in range(subjects):
            for _ in range(r.randint(1, 9)):
                out.append((c, f"{c}{s}", n))
                n += 1
    return out


def number(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def twin(cells, size, cap, replacement, seed, samples, epoch):
    """Lists of classes, subjects and cells that shrink as they are used up."""
    own = collections.defaultdict(list)
    for c, s, cell in sorted(cells, key=lambda x: x[2]):
        own[c, s].append(cell)
    capacity = {k: cap if replacement else min(cap, len(v)) for k, v in own.items()}
    out, p = [], dict(P)
    for b in range(-(-samples // size)):
        left = {c: sorted((k for k in own if k[0] == c), key=lambda k: (capacity[k], hashlib.md5(k[1].encode()).hexdigest(), k[1])) for c in sorted({k[0] for k in own})}
        used, free = collections.Counter(), {k: list(v) for k, v in own.items()}
        for i in range(min(size, samples - b * size)):
            classes = [c for c in left if left[c]]
            total, u, at = sum(p[c] for c in classes), number(f"{seed}|class|{epoch}|{b}|{i}") / 2**32, 0.0
            for c in classes:
                at += p[c] / total
                if u < at:
                    break
            k = left[c][number(f"{seed}|subject|{epoch}|{b}|{i}") % len(left[c])]
            u = number(f"{seed}|cell|{epoch}|{b}|{i}")
            cell = own[k][u % len(own[k])] if replacement else free[k].pop(u % len(free[k]))
            used[k] += 1
            if used[k] == capacity[k]:
                left[c].remove(k)
            out.append((b, i, c, k[1], cell))
    return out


@pytest.mark.parametrize("replacement", [True, False])
@pytest.mark.parametrize("epoch", [0, 3])
def test_batches_against_a_twin(spark, replacement, epoch):
    cells = rows()
    table = spark.createDataFrame([*cells, (None, "x", 900), ("a", None, 901)], "label string, subject_id string, cell_id long")
    p = spark.createDataFrame(P, "label string, p double")
    want = twin(cells, 25, 3, replacement, 4, 110, epoch)
    for parts in (1, 6):
        got = B.capped_batches(table.repartition(parts), p, 25, 3, replacement, 4, samples=110, epoch=epoch)
        assert sorted(map(tuple, got.collect())) == want
    report = {r["batch"]: r for r in B.batch_report(got).collect()}
    assert [report[b]["n"] for b in range(5)] == [25] * 4 + [10]
    assert all(r["most_of_a_subject"] <= 3 for r in report.values()) and any(r["most_of_a_subject"] == 3 for r in report.values())
    if not replacement:
        assert all(r["repeated_cells"] == 0 for r in report.values())
        # class a has six places at most, which half of 25 draws would pass: the cap binds and the others fill the batch
        assert all(sum(c == "a" and b == k for b, _, c, _, _ in want) <= 6 for k in range(5))


def test_epochs_differ_and_infeasible_requests_fail(spark):
    table = spark.createDataFrame(rows(), "label string, subject_id string, cell_id long")
    p = spark.createDataFrame(P, "label string, p double")
    draw = lambda **k: B.capped_batches(table, p, **({"batch_size": 10, "cap": 2, "replacement": True, "seed": 1, "batches": 2} | k))
    assert sorted(map(tuple, draw(epoch=0).collect())) != sorted(map(tuple, draw(epoch=1).collect()))
    assert draw(batches=None, samples=4).count() == 4
    for broken in ({"batch_size": 33}, {"batch_size": 0}, {"cap": 0}, {"samples": 5}, {"batches": None}, {"batches": -1}):
        with pytest.raises(ContractError):
            draw(**broken)
    with pytest.raises(ContractError):
        B.capped_batches(table, p.where("label <> 'c'"), 10, 2, True, 1, batches=1)
    both = spark.createDataFrame([("a", "s", 1), ("b", "s", 2)], "label string, subject_id string, cell_id long")
    with pytest.raises(ContractError):
        B.capped_batches(both, p, 1, 1, True, 1, batches=1)


def test_remaining():
    assert [B.remaining(k, [0, 2, 3]) for k in range(4)] == [1, 4, 5, 6] and B.remaining(5, []) == 5
