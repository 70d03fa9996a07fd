"""Immutable, fingerprinted results: write once, verify, reload; allow-listed publication."""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.operators.cohorts import ContractError, require_none
from cohortloom.operators.splits import fingerprint, oof_problems
from cohortloom.operators.texts import PROHIBITED_VALUES

#: Parts of key names that a publication must not have (fixed values).
PROHIBITED = ("path", "subject_id", "patient", "barcode", "password", "secret", "token", "api_key")


def canonical(value: object) -> str:
    """JSON with sorted keys and no spaces: equal values give equal text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(value: object) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def write_atomic(path: str | Path, data: bytes, exclusive: bool = False) -> None:
    """All or nothing; exclusive: an error if the file is there, also against a writer at the same time."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=path.parent)
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        if exclusive:
            os.link(name, path)
        else:
            os.replace(name, path)
            return
    finally:
        if os.path.exists(name):
            os.unlink(name)


def write_json(path: str | Path, value: object, exclusive: bool = False) -> str:
    """Write with its fingerprint, reload and compare; returns the fingerprint."""
    mark = digest(value)
    write_atomic(path, canonical({"value": value, "fingerprint": mark}).encode(), exclusive)
    if read_json(path) != json.loads(canonical(value)):
        raise ContractError(f"{path} does not read back")
    return mark


def read_json(path: str | Path) -> object:
    """The value, if its fingerprint holds."""
    found = json.loads(Path(path).read_text())
    if digest(found["value"]) != found["fingerprint"]:
        raise ContractError(f"{path} was changed")
    return found["value"]


def write_frame(df: DataFrame, path: str, key: list[str], partition_by: list[str] = ()) -> dict:
    """Parquet written once, with a count and an order-free content digest; the manifest is the caller's to keep."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return frame_manifest(df.sparkSession.read.parquet(path), key)


def frame_manifest(df: DataFrame, key: list[str]) -> dict:
    columns = sorted(df.columns)
    row = df.agg(F.count("*").alias("n"), F.count_distinct(*key).alias("keys"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string").alias("sum"), F.bit_xor(F.xxhash64(F.lit(1), *columns)).alias("xor")).first()
    return {"rows": row["n"], "keys": row["keys"], "columns": columns, "sum": row["sum"], "xor": row["xor"]}


def verify_frame(spark: SparkSession, path: str, key: list[str], manifest: dict) -> DataFrame:
    """The table, if rows, keys, columns and content are as in the manifest."""
    df = spark.read.parquet(path)
    if frame_manifest(df, key) != manifest:
        raise ContractError(f"{path} is not what its manifest says")
    return df


def write_predictions(subjects: DataFrame, predictions: DataFrame, path: str) -> dict:
    """Out-of-fold predictions (subject_id, p, fold, subject_fold, ...) written once, a row a subject; the manifest, after reading back.

    A subject without a prediction, with two, not of the pool, predicted by a model that was trained on it, or with a p that is no number is an error before anything is written.
    """
    require_none(oof_problems(subjects, predictions), F.lit(True), "out-of-fold predictions that may not be kept")
    manifest = write_frame(predictions, path, ["subject_id"])
    verify_frame(predictions.sparkSession, path, ["subject_id"], manifest)
    return manifest


def prohibited_keys(value: object, at: str = "") -> list[str]:
    """Where a nested value has keys that must not be published."""
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in ([f"{at}/{k}"] if any(x in k.lower() for x in PROHIBITED) else []) + prohibited_keys(v, f"{at}/{k}")]
    if isinstance(value, list):
        return [p for i, v in enumerate(value) for p in prohibited_keys(v, f"{at}/{i}")]
    return []


def prohibited_values(value: object, at: str = "") -> list[str]:
    """Where a nested value holds text that must not be published."""
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in prohibited_values(v, f"{at}/{k}")]
    if isinstance(value, list):
        return [p for i, v in enumerate(value) for p in prohibited_values(v, f"{at}/{i}")]
    return [at] if isinstance(value, str) and re.search(PROHIBITED_VALUES, value) else []


def publish(path: str | Path, report: dict, allowed: list[str]) -> str:
    """Write the allowed top-level keys, once, if nothing prohibited is in their keys or values."""
    summary = {k: report[k] for k in allowed if k in report}
    if found := prohibited_keys(summary) + prohibited_values(summary):
        raise ContractError(f"not to be published: {found}")
    return write_json(path, summary, exclusive=True)


class FrozenTestGuard:
    """A one-shot gate: the first owner may evaluate on the test set, and completes or fails; nobody may again."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def acquire(self, owner: str) -> None:
        try:
            write_atomic(self.path, canonical({"state": "in_progress", "owner": owner}).encode(), exclusive=True)
        except FileExistsError:
            raise ContractError(f"the test set was used: {self.state()}") from None

    def state(self) -> dict:
        return json.loads(self.path.read_text())

    def close(self, owner: str, state: str) -> None:
        now = self.state()
        if now != {"state": "in_progress", "owner": owner} or state not in ("completed", "failed"):
            raise ContractError(f"{owner} can't set {state}: {now}")
        write_atomic(self.path, canonical({"state": state, "owner": owner}).encode())


def export_cells(cells: DataFrame, path: str, policy: str) -> dict:
    """Cells as parquet by source, with a fingerprinted metadata file beside them."""
    from cohortloom.operators.cohorts import assert_rows_match_policy

    manifest = write_frame(assert_rows_match_policy(cells, policy), f"{path}/cells", ["cell_id"], ["source"])
    write_json(f"{path}/dataset_metadata.json", {"policy": policy, "cells": manifest})
    return manifest


def load_cells(spark: SparkSession, path: str) -> DataFrame:
    return verify_frame(spark, f"{path}/cells", ["cell_id"], read_json(f"{path}/dataset_metadata.json")["cells"])


def write_bundle(model, path: str, artifact: DataFrame, spark: SparkSession) -> dict:
    """A fitted pipeline with the preprocessing artifact it belongs to, bound by checksums; the manifest is written last."""
    model.write().save(f"{path}/model")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/model").where("length > 0")
    marks = sorted(r[0] for r in files.select(F.sha2("content", 256)).collect())  # a pipeline's few files
    manifest = {"model": digest(marks), "artifact": write_frame(artifact, f"{path}/artifact", ["gene"])}
    write_json(f"{path}/manifest.json", manifest, exclusive=True)
    return manifest


def load_bundle(spark: SparkSession, path: str):
    """(model, artifact), if neither was changed since."""
    from pyspark.ml import PipelineModel

    manifest = read_json(f"{path}/manifest.json")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/model").where("length > 0")
    if digest(sorted(r[0] for r in files.select(F.sha2("content", 256)).collect())) != manifest["model"]:
        raise ContractError(f"{path}/model was changed")
    return PipelineModel.load(f"{path}/model"), verify_frame(spark, f"{path}/artifact", ["gene"], manifest["artifact"])


def write_report(path: str | Path, title: str, sections: dict[str, DataFrame]) -> None:
    """A markdown report of small tables; each may have at most 1,000 rows."""
    out = [f"# {title}", ""]
    for name, df in sections.items():
        rows = df.limit(1001).collect()
        if len(rows) > 1000:
            raise ContractError(f"{name} is too long for a report")
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows] + [""]
    write_atomic(path, "\n".join(out).encode())


def save_fold(artifact: DataFrame, root: str, fold: str | int, train: DataFrame, val: DataFrame) -> dict:
    """A fold's preprocessing artifact (gene, ...) with the fingerprints of the subjects it was fitted on and is held against; the manifest is written last."""
    at = f"{root}/preprocessing/fold_{fold:02d}" if isinstance(fold, int) else f"{root}/preprocessing/fold_{fold}"
    marks = {name: fingerprint(df.select("subject_id").distinct(), "", "subject_id").first()[0] for name, df in (("train", train), ("val", val))}
    manifest = {"fold": fold, "artifact": write_frame(artifact, f"{at}/artifact", ["gene"]), "subjects": marks, "status": "complete"}
    write_json(f"{at}/manifest.json", manifest, exclusive=True)
    return manifest


def load_fold(spark: SparkSession, root: str, fold: str | int, train: DataFrame | None = None, val: DataFrame | None = None) -> DataFrame:
    """The artifact, if it is complete, unchanged, and of the subjects expected."""
    at = Path(f"{root}/preprocessing/fold_{fold:02d}" if isinstance(fold, int) else f"{root}/preprocessing/fold_{fold}")
    if not (at / "manifest.json").exists():
        raise ContractError(f"{at} is incomplete")
    manifest = read_json(at / "manifest.json")
    for name, df in (("train", train), ("val", val)):
        if df is not None and fingerprint(df.select("subject_id").distinct(), "", "subject_id").first()[0] != manifest["subjects"][name]:
            raise ContractError(f"{at} belongs to other {name} subjects")
    return verify_frame(spark, str(at / "artifact"), ["gene"], manifest["artifact"])


def write_run(root: str | Path, run_id: str, files: dict[str, object], status: str = "complete") -> dict:
    """An evidence run: JSON files in a folder of its own, each with its SHA-256 in a manifest that is written last. A run is never written twice."""
    at = Path(root) / run_id
    if not re.fullmatch(r"[A-Za-z0-9._-]+", run_id) or any(Path(n).is_absolute() or ".." in Path(n).parts for n in files):
        raise ContractError(f"names of {run_id} leave its folder")
    if (at / "manifest.json").exists():
        raise ContractError(f"{run_id} is written")
    marks = {}
    for name, value in sorted(files.items()):
        data = canonical(value).encode()
        write_atomic(at / name, data)
        marks[name] = hashlib.sha256(data).hexdigest()
    manifest = {"run_id": run_id, "files": marks, "status": status}
    write_json(at / "manifest.json", manifest, exclusive=True)
    return manifest


def validate_run(root: str | Path, run_id: str) -> dict:
    """The manifest, if every file is as written and no other is there."""
    at = Path(root) / run_id
    manifest = read_json(at / "manifest.json")
    found = {str(p.relative_to(at)): hashlib.sha256(p.read_bytes()).hexdigest() for p in at.rglob("*") if p.is_file() and p.name != "manifest.json"}
    if found != manifest["files"]:
        raise ContractError(f"{run_id}: {sorted(set(found) ^ set(manifest['files'])) or 'contents'} differ from the manifest")
    return manifest


def list_runs(root: str | Path) -> list[str]:
    """Runs that are complete, by name."""
    return sorted(p.parent.name for p in Path(root).glob("*/manifest.json") if read_json(p)["status"] == "complete")


def write_table_report(path: str | Path, df: DataFrame, required: list[str], most: int = 1000) -> str:
    """A robustness or ablation table as a fingerprinted record: the required columns must be there, and all rows, of which there may be so many."""
    if missing := [c for c in required if c not in df.columns]:
        raise ContractError(f"{path} lacks {missing}")
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ContractError(f"{path} is no table of results")
    return write_json(path, {"columns": df.columns, "rows": sorted(([r[c] for c in df.columns] for r in rows), key=repr)}, exclusive=True)
