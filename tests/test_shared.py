"""Records on shared storage: races, dead writers, damage, and one judgement of test rows."""

import threading

import pytest
from pyspark.sql import functions as F

from cohortloom.operators.calibration import Calibrator, FrozenPolicy
from cohortloom.operators.cohorts import ContractError
from cohortloom.sources import shared


@pytest.fixture(params=["path", "uri"])
def folder(request, spark, tmp_path):
    return shared.Folder(spark, f"file://{tmp_path}/runs" if request.param == "uri" else f"{tmp_path}/runs")


def race(jobs):
    out, start = [], threading.Barrier(len(jobs))

    def go(job):
        start.wait()
        try:
            out.append(("won", job()))
        except ContractError as e:
            out.append(("lost", str(e)))

    threads = [threading.Thread(target=go, args=(j,)) for j in jobs]
    [t.start() for t in threads]
    [t.join() for t in threads]
    return out


def test_one_of_many_writers_wins(folder):
    got = race([lambda k=k: shared.write_run(folder, "run", {"a.json": {"writer": k}, "deep/b.json": [k]}) for k in range(6)])
    assert sorted(g for g, _ in got) == ["lost"] * 5 + ["won"]
    manifest = next(m for g, m in got if g == "won")
    assert shared.read_run(folder, "run") == manifest and shared.complete_runs(folder) == ["run"] and set(manifest["files"]) == {"a.json", "deep/b.json"}


def test_a_dead_writer_leaves_nothing_that_is_read(folder, monkeypatch):
    publish = shared.Folder.publish

    def dies(self, name, data):
        if name.endswith("manifest.json"):
            raise KeyboardInterrupt
        publish(self, name, data)

    monkeypatch.setattr(shared.Folder, "publish", dies)
    with pytest.raises(KeyboardInterrupt):
        shared.write_run(folder, "dead", {"a.json": 1})
    monkeypatch.undo()
    assert shared.complete_runs(folder) == []
    for ask in (shared.read_run, lambda f, r: shared.write_run(f, r, {})):
        with pytest.raises(ContractError):
            ask(folder, "dead")


def test_changed_and_added_files_are_found(folder, tmp_path):
    shared.write_run(folder, "run", {"a.json": {"x": 1}})
    (tmp_path / "runs/run/b.json").write_text("1")
    with pytest.raises(ContractError, match="b.json"):
        shared.read_run(folder, "run")
    (tmp_path / "runs/run/b.json").unlink()
    (tmp_path / "runs/run/.a.json.crc").unlink(missing_ok=True)
    (tmp_path / "runs/run/a.json").write_text('{"x":2}')
    with pytest.raises(ContractError, match="contents"):
        shared.read_run(folder, "run")
    for name in ("../x", "/x"):
        with pytest.raises(ContractError):
            folder.read(name)
    for run in ("", "a/b", "_x", ".x"):
        with pytest.raises(ContractError):
            shared.write_run(folder, run, {})


def test_test_rows_are_judged_once_by_any_session(spark, folder, tmp_path):
    policy = FrozenPolicy(Calibrator("none"), 0.5, "youden")
    test = spark.createDataFrame([(0, 0.2), (1, 0.8), (1, 0.4)], "y_true int, y_prob double")
    guard = shared.TestGuard(folder, "final")
    assert guard.state() == "free"
    others = [shared.TestGuard(shared.Folder(spark.newSession(), folder.root), "final") for _ in range(3)]
    got = race([lambda g=g: g.judge(FrozenPolicy(Calibrator("none"), 0.5, "youden"), test) for g in [guard, *others]])
    assert sorted(g for g, _ in got) == ["lost"] * 3 + ["won"] and all(g.state() == "completed" for g in others)
    assert next(r for g, r in got if g == "won")[0]["sensitivity"] == 0.5
    with pytest.raises(ContractError, match="completed"):
        guard.judge(policy, test)
    broken = shared.TestGuard(folder, "broken")
    with pytest.raises(Exception, match="zero|ZERO"):
        broken.judge(policy, test, lambda p, t: t.select((F.lit(1) / F.lit(0)).alias("x")))
    assert broken.state() == "failed"
    with pytest.raises(ContractError, match="failed"):
        broken.judge(policy, test)
    for p in (tmp_path / "runs/final").glob(".outcome*"):
        p.unlink()
    (tmp_path / "runs/final/outcome.json").write_text("{")
    with pytest.raises(ContractError, match="damaged"):
        guard.state()
