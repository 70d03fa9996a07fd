"""Records that are written once on storage which several drivers share, through Spark's own file systems.

A claim is a file that can be created only once; whoever creates it owns the name. Data files follow, and a manifest with the SHA-256 of
each comes last, under another name until it is whole: it is the commit. A writer that dies before leaves a claim and no record,
which nobody reads, and which nobody takes over without being told to. A guard binds one judgement of test rows to such a claim.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cohortloom.operators.calibration import FrozenPolicy
from cohortloom.operators.cohorts import ContractError
from cohortloom.sources.artifacts import canonical, digest


class Folder:
    """A folder by any path or URI that Spark's file systems know."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self._jvm = root.rstrip("/"), spark._jvm
        at = self._path("")
        self._fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        self._local = self._fs.getUri().getScheme() == "file"

    def _path(self, name: str):
        if name.startswith("/") or ".." in name.split("/"):
            raise ContractError(f"{name} leaves its folder")
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def names(self, name: str = "") -> list[str]:
        """Files under a folder, by their path from it; those of writers that have not finished, and check sums, are left out."""
        if not self.exists(name):
            return []
        top, found = self._fs.makeQualified(self._path(name)).toString() + "/", self._fs.listFiles(self._path(name), True)
        out = []
        while found.hasNext():
            out.append(found.next().getPath().toString().removeprefix(top))
        return sorted(n for n in out if not any(part.startswith((".", "_")) for part in n.split("/")))

    def _create(self, name: str, data: bytes) -> None:
        stream = self._fs.create(self._path(name), False)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def claim(self, name: str, data: bytes) -> bool:
        """Create a file if nobody has; False if somebody has, also at the same time.

        HDFS and stores with conditional writes decide by their own create; a local disk decides by opening the file exclusively.
        """
        path = self._path(name)
        self._fs.mkdirs(path.getParent())
        if self._local:
            try:
                with os.fdopen(os.open(self._fs.makeQualified(path).toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644), "wb") as f:
                    f.write(data)
                    f.flush()
                    os.fsync(f.fileno())
            except FileExistsError:
                return False
            return True
        if self._fs.exists(path):
            return False
        try:
            self._create(name, data)
        except Exception:
            if self._fs.exists(path):
                return False
            raise
        return True

    def publish(self, name: str, data: bytes) -> None:
        """A whole file or none: written beside and renamed. Only the owner of a claim may, so no file is there."""
        beside = f"{'/'.join(name.split('/')[:-1] + [f'_{uuid.uuid4().hex}'])}".lstrip("/")
        if self.exists(name):
            raise ContractError(f"{name} is written")
        self._create(beside, data)
        if not self._fs.rename(self._path(beside), self._path(name)):
            raise ContractError(f"{name} could not be put in place")


def write_run(folder: Folder, run_id: str, files: dict[str, object]) -> dict:
    """A run of JSON files under its id, committed by its manifest. An id that is claimed, by a run that is complete or one that is not, is an error."""
    if not run_id or "/" in run_id or run_id.startswith((".", "_")):
        raise ContractError(f"{run_id} names no run")
    if not folder.claim(f"{run_id}/_owner", uuid.uuid4().hex.encode()):
        raise ContractError(f"{run_id} is {'written' if folder.exists(f'{run_id}/manifest.json') else 'being written, or was left by a writer that died'}")
    marks = {}
    for name, value in sorted(files.items()):
        if name == "manifest.json":
            raise ContractError("the manifest is written last")
        data = canonical(value).encode()
        folder.publish(f"{run_id}/{name}", data)
        marks[name] = hashlib.sha256(data).hexdigest()
    manifest = {"run_id": run_id, "files": marks}
    folder.publish(f"{run_id}/manifest.json", canonical({"value": manifest, "fingerprint": digest(manifest)}).encode())
    return read_run(folder, run_id)


def read_run(folder: Folder, run_id: str) -> dict:
    """The manifest of a committed run, if it and every file are as written and no other is there."""
    if not folder.exists(f"{run_id}/manifest.json"):
        raise ContractError(f"{run_id} is not complete")
    found = json.loads(folder.read(f"{run_id}/manifest.json"))
    if digest(found["value"]) != found["fingerprint"]:
        raise ContractError(f"the manifest of {run_id} was changed")
    marks = {n: hashlib.sha256(folder.read(f"{run_id}/{n}")).hexdigest() for n in folder.names(run_id) if n != "manifest.json"}
    if marks != found["value"]["files"]:
        raise ContractError(f"{run_id}: {sorted(set(marks) ^ set(found['value']['files'])) or 'contents'} differ from the manifest")
    return found["value"]


def complete_runs(folder: Folder) -> list[str]:
    """Runs with a manifest, by name; what dead writers left is not among them."""
    return sorted(n.split("/")[0] for n in folder.names() if n.count("/") == 1 and n.endswith("/manifest.json"))


@dataclass(frozen=True)
class TestGuard:
    """One judgement of test rows under a name, whichever session asks: claimed before any test row is read, closed with what came of it."""

    __test__ = False  # no test class
    folder: Folder
    name: str

    def state(self) -> str:
        """free, in_progress, completed or failed; a record that cannot be read is an error, never free."""
        if not self.folder.exists(f"{self.name}/_owner"):
            return "free"
        if not self.folder.exists(f"{self.name}/outcome.json"):
            return "in_progress"
        try:
            return json.loads(self.folder.read(f"{self.name}/outcome.json"))["status"]
        except (ValueError, KeyError) as e:
            raise ContractError(f"the guard {self.name} was damaged") from e

    def judge(self, policy: FrozenPolicy, test: DataFrame, run: Callable[[FrozenPolicy, DataFrame], DataFrame] = FrozenPolicy.evaluate) -> list:
        """Rows of run(policy, test), computed once ever. A second judgement, by this or another session or policy, and one after a failure, is an error."""
        claim = {"policy": policy.fingerprint, "token": uuid.uuid4().hex}
        if not self.folder.claim(f"{self.name}/_owner", canonical(claim).encode()):
            raise ContractError(f"test rows of {self.name}: {self.state()}")
        try:
            rows = run(policy, test).collect()  # metrics: a few rows
        except BaseException as e:
            self.folder.publish(f"{self.name}/outcome.json", canonical(claim | {"status": "failed", "error": type(e).__name__}).encode())
            raise
        self.folder.publish(f"{self.name}/outcome.json", canonical(claim | {"status": "completed", "rows": [r.asDict() for r in rows]}).encode())
        return rows
