"""Versions of a table in folders, each named by a manifest.

A version's data lie in a folder of its own attempt; its manifest, a small JSON
file with the version's number, is put in place by a rename that fails if the
number is taken. What no manifest names is invisible: data of attempts that were
lost, and of versions before the last two, are removed by later versions.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

_FOLDER = "_manifests"
#: Versions that are kept, so that readers of the one before can end.
KEPT = 2


@dataclass
class Manifest:
    """One version: its folders by bucket, what is in quarantine, the last batch of each writer, and how many lines were merged and are in quarantine."""

    version: int = 0
    attempt: str = ""
    buckets: int | None = None
    folders: dict[str, str] = field(default_factory=dict)
    quarantine: list[str] = field(default_factory=list)
    owners: dict[str, int] = field(default_factory=dict)
    merged: int = 0
    quarantined: int = 0

    def following(self, owner: str, number: int, merged: int) -> Manifest:
        """The version after this one, with the same data so far."""
        version = self.version + 1
        return Manifest(version, f"version={version:09d}-{uuid.uuid4().hex}", self.buckets, dict(self.folders), list(self.quarantine), self.owners | {owner: number}, self.merged + merged, self.quarantined)


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Names in a folder, in order."""
    fs, where = _fs(spark, f"{folder}/{pattern}")
    return sorted(f.getPath().getName() for f in fs.globStatus(where) or [])


def _read(spark: SparkSession, target: str, name: str) -> Manifest:
    fs, where = _fs(spark, f"{target}/{_FOLDER}/{name}")
    stream = fs.open(where)
    try:
        return Manifest(**json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def last(spark: SparkSession, target: str) -> Manifest:
    """The last version; one without anything, number 0, if there is none."""
    found = names(spark, f"{target}/{_FOLDER}", "*.json")
    return _read(spark, target, found[-1]) if found else Manifest()


def commit(spark: SparkSession, target: str, manifest: Manifest) -> None:
    """Makes a version the last one, and removes what only versions before the last two have."""
    fs, place = _fs(spark, f"{target}/{_FOLDER}/{manifest.version:09d}.json")
    _, draft = _fs(spark, f"{target}/{_FOLDER}/.{uuid.uuid4().hex}")
    fs.mkdirs(place.getParent())
    stream = fs.create(draft, False)
    stream.write(bytearray(json.dumps(asdict(manifest)).encode()))
    stream.close()
    if fs.exists(place) or not fs.rename(draft, place):
        fs.delete(draft, False)
        raise RuntimeError(f"version {manifest.version} of {target} was written by another stream")
    found = names(spark, f"{target}/{_FOLDER}", "*.json")
    for name in found[:-KEPT]:
        fs.delete(_fs(spark, f"{target}/{_FOLDER}/{name}")[1], False)
    kept = [_read(spark, target, name) for name in found[-KEPT:]]
    named = {f.split("/")[0] for m in kept for f in [*m.folders.values(), *m.quarantine]} | {m.attempt for m in kept}
    for name in names(spark, target, "version=*"):
        if name not in named and int(name.split("=")[1].split("-")[0]) <= manifest.version:
            fs.delete(_fs(spark, f"{target}/{name}")[1], True)
