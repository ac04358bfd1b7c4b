"""Snapshots and checkpoints as files that replace each other as a whole.

A version is written beside the others and becomes visible by one small numbered
marker, written under a name of its own and renamed to a number that did not exist; the
highest readable number counts. So a reader sees the former or the new version, never a half and never none, and
the former one stays for those that still read it until the next but one.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..scratch import Scratch


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A folder in the shared scratch space, removed with the session."""
    return Scratch(spark, name).root


class SnapshotStore:
    """SNK-01: the latest snapshot; one of another schema version reads as none. A snapshot is one part, or several that were appended."""

    KEEP = 2

    def __init__(self, spark: SparkSession, folder: str, schema_version: int):
        self.spark, self.folder, self.version = spark, folder.rstrip("/"), schema_version
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def save(self, df: DataFrame) -> None:
        """Writes ``df`` and makes it the latest. ``df`` may be read from the former snapshot."""
        self._publish([self._part(df)])

    def append(self, df: DataFrame, fold: Callable[[DataFrame], DataFrame]) -> None:
        """Adds a part. ``fold`` brings rows of one key down to one; parts are folded together when the newer is half as large as the older.

        So a row is written again only as often as the snapshot doubles, not with every part.
        """
        parts = [*self._parts(), self._part(fold(df))]
        while len(parts) > 1 and parts[-2]["rows"] <= 2 * parts[-1]["rows"]:
            parts[-2:] = [self._part(fold(self._read(parts[-2:])))]
        self._publish(parts)

    def load_latest(self) -> DataFrame | None:
        """All parts of the latest snapshot. Appended parts may hold older rows of a key."""
        parts = self._parts()
        return self._read(parts) if parts else None

    def clear(self) -> None:
        self._fs.delete(self._path(self.folder), True)

    def _part(self, df: DataFrame) -> dict:
        name = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{name}")
        return {"data": name, "rows": self.spark.read.parquet(f"{self.folder}/{name}").count()}

    def _read(self, parts: list[dict]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.folder}/{p['data']}" for p in parts])

    def _parts(self) -> list[dict]:
        found = self._markers()
        return found[0][1]["parts"] if found and found[0][1].get("schema_version") == self.version else []

    def _publish(self, parts: list[dict]) -> None:
        former = self._markers()
        number = max(self._numbers(), default=-1) + 1
        new = self._path(f"{self.folder}/marker-{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(new, True)
        stream.write(bytearray(json.dumps({"schema_version": self.version, "parts": parts}).encode()))
        stream.close()
        if not self._fs.rename(new, self._path(f"{self.folder}/marker-{number:012}.json")):
            raise RuntimeError(f"another writer published snapshot {number}")
        # What neither this nor the former snapshot holds may go.
        used = {p["data"] for p in parts} | {p["data"] for _, m in former[: self.KEEP - 1] for p in m["parts"]}
        for n, marker in former[self.KEEP - 1 :]:
            self._fs.delete(self._path(f"{self.folder}/marker-{n:012}.json"), False)
            for p in marker["parts"]:
                if p["data"] not in used:
                    self._fs.delete(self._path(f"{self.folder}/{p['data']}"), True)

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        found = (re.fullmatch(r"marker-(\d+)\.json", s.getPath().getName()) for s in self._fs.listStatus(self._path(self.folder)))
        return [int(m.group(1)) for m in found if m]

    def _markers(self) -> list[tuple[int, dict]]:
        """Readable markers, the latest first; a broken one counts as missing."""
        read = ((n, self._marker(self._path(f"{self.folder}/marker-{n:012}.json"))) for n in sorted(self._numbers(), reverse=True))
        return [(n, m) for n, m in read if m]

    def _marker(self, path) -> dict | None:
        try:
            stream = self._fs.open(path)
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            found = json.loads(text)
            return found if isinstance(found, dict) and isinstance(found.get("parts"), list) else None
        except ValueError:
            return None


class CheckpointStore:
    """SNK-02: the latest evidence of each kind."""

    def __init__(self, spark: SparkSession, folder: str, schema_version: int):
        self.spark, self.folder, self.version = spark, folder.rstrip("/"), schema_version

    def _store(self, kind: str) -> SnapshotStore:
        return SnapshotStore(self.spark, f"{self.folder}/kind={kind}", self.version)

    def save(self, kind: str, df: DataFrame) -> None:
        self._store(kind).save(df)

    def load(self, kind: str) -> DataFrame | None:
        return self._store(kind).load_latest()

    def clear(self, kind: str) -> None:
        self._store(kind).clear()


def upsert(target: DataFrame, changed: DataFrame, deleted: DataFrame, key: str = "id") -> DataFrame:
    """SNK-06: ``target`` with the rows of ``changed`` in place of their own, without ``deleted``; to be written as one new version."""
    gone = changed.select(key).unionByName(deleted.select(key)).distinct()
    kept = target.join(gone, key, "left_anti")
    return kept.unionByName(changed.join(deleted.select(key).distinct(), key, "left_anti"))
