"""Small stores as a log of commits over Parquet: facts, digest, journal.

A commit is a numbered file that names the rows it adds, or that replace all before. Its number is claimed by creating the file, which
only one writer can do; rows are written before, under a name of their own, so a reader never sees half of them and a writer
that dies leaves the store as it was. An append takes the next free number and loses nothing to others; a change that read the
store first counts only from the version it read, and is made again if another came between.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.corpus import covered
from lodestone.operators.memory import REFUSE, WARN

FACTS = "id string, text string, tags array<string>, created timestamp, context string"
DIGEST = "text string, covers array<string>, saved_at timestamp"
JOURNAL = "seq long, ts timestamp, tool string, hint string"


class Store:
    """``read`` gives the rows of the newest commit (none at first), ``append`` adds some, ``update`` replaces them by a function of them.

    ``history`` replaced states stay on disk.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, history: int = 2) -> None:
        self.spark, self.folder, self.schema, self.history = spark, folder.rstrip("/"), schema, history
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs, self._path = path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder)) if s.isFile()]
        return sorted(int(n[1:]) for n in names if re.fullmatch(r"v\d+", n))

    def _claim(self, version: int, adds: bool, rows: str) -> bool:
        """Create a commit's file; False if another writer was first."""
        name = f"v{version}"
        # The name of the file says it all but what it holds, so a reader that finds it finds it whole.
        staged = f"{self.folder}/{rows}.json"
        out = self._fs.create(self._path(staged), True)
        out.write(json.dumps({"adds": adds, "rows": rows}).encode())
        out.close()
        target = self._path(f"{self.folder}/{name}")
        try:
            if self._fs.getScheme() == "file":  # a rename would replace what is there, a link does not
                files, at = self.spark._jvm.java.nio.file.Files, self.spark._jvm.java.net.URI
                link = lambda p: self.spark._jvm.java.nio.file.Path.of(at(self._fs.makeQualified(p).toUri().toString()))
                files.createLink(link(target), link(self._path(staged)))
                return True
            return bool(self._fs.rename(self._path(staged), target))  # fails where the target exists
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            if self._fs.exists(self._path(staged)):
                self._fs.delete(self._path(staged), False)

    def _commit(self, version: int) -> dict:
        data = self._fs.open(self._path(f"{self.folder}/v{version}"))
        try:
            return json.loads(bytes(data.readAllBytes()).decode())
        finally:
            data.close()

    def _state(self, versions: list[int]) -> list[str]:
        """The folders of rows that make the newest of ``versions``."""
        folders: list[str] = []
        for version in reversed(versions):
            commit = self._commit(version)
            folders.append(commit["rows"])
            if not commit["adds"]:
                break
        return [f"{self.folder}/{x}" for x in folders]

    def _rows(self, versions: list[int]) -> DataFrame:
        folders = self._state(versions)
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def _written(self, rows: DataFrame) -> str:
        name = f"rows-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{name}")
        return name

    def read(self) -> DataFrame:
        return self._rows(self.versions())

    def append(self, rows: DataFrame) -> None:
        """Add rows; what others add meanwhile stays too."""
        name, version = self._written(rows), (self.versions() or [0])[-1] + 1
        while not self._claim(version, True, name):
            version += 1

    def update(self, change: Callable[[DataFrame], DataFrame], most: int = 1000) -> None:
        """Replace the rows by ``change`` of them, of the newest state; up to ``most`` tries where others commit meanwhile."""
        for _ in range(most):
            known = self.versions()
            try:
                name = self._written(change(self._rows(known)))
            except Exception:
                if self.versions() == known:
                    raise
                continue  # what was read has been replaced, and is gone
            if self._claim(known[-1] + 1 if known else 1, False, name):
                self._forget()
                return
            self._fs.delete(self._path(f"{self.folder}/{name}"), True)
        raise RuntimeError(f"{self.folder} changed {most} times while it was being changed")

    def replace(self, rows: DataFrame) -> None:
        """Replace all rows, whatever they are."""
        self.update(lambda _: rows)

    def _forget(self) -> None:
        """Delete commits, and their rows, before the last ``history`` replaced states."""
        try:
            commits = [(v, self._commit(v)) for v in self.versions()]
        except Exception:  # another writer is at it
            return
        whole = [v for v, c in commits if not c["adds"]]
        for version, commit in commits if len(whole) > self.history else ():
            if version < whole[-self.history]:
                for name in (f"v{version}", commit["rows"]):
                    self._fs.delete(self._path(f"{self.folder}/{name}"), True)


def save_fact(store: Store, text: str, tags: list[str], context: str | None = None) -> tuple[str, str]:
    """(id, level) of a saved fact: ``warn`` for a long one; ValueError for one that is too long."""
    if len(text) > REFUSE:
        raise ValueError(f"a fact of {len(text)} characters is refused; {REFUSE} are the most")
    row = store.spark.createDataFrame([(text, tags, context)], "text string, tags array<string>, context string").select(F.substring(F.expr("uuid()"), 1, 8).alias("id"), "text", "tags", F.current_timestamp().alias("created"), "context").collect()
    store.append(store.spark.createDataFrame(row, FACTS))
    return row[0]["id"], "warn" if len(text) > WARN else "ok"


def get_facts(store: Store, ids: list[str]) -> tuple[DataFrame, list[str]]:
    """(facts, ids that are not there)."""
    rows = store.read().filter(F.col("id").isin(*ids))
    known = {r["id"] for r in rows.select("id").collect()}
    return rows, [i for i in ids if i not in known]


def delete_facts(store: Store, ids: list[str]) -> None:
    store.update(lambda rows: rows.filter(~F.col("id").isin(*ids)))


def save_digest(store: Store, text: str, covers: list[str]) -> None:
    """Replace the digest: prose about the files under ``covers`` (all files if none is given)."""
    row = store.spark.createDataFrame([(text, covers)], "text string, covers array<string>").withColumn("saved_at", F.current_timestamp())
    store.replace(store.spark.createDataFrame(row.collect(), DIGEST))


def get_digest(store: Store, scan: DataFrame) -> tuple[str, list[str], DataFrame] | None:
    """(text, covers, stale): the saved digest and the covered files of a scan (path, mtime) that are newer; None without one."""
    rows = store.read().limit(1).collect()
    if not rows:
        return None
    newer = F.unix_millis(F.col("mtime").cast("timestamp")) > F.unix_millis(F.lit(rows[0]["saved_at"])) + 1
    return rows[0]["text"], rows[0]["covers"], covered(scan, [c.replace("\\", "/").rstrip("/") for c in rows[0]["covers"]]).filter(newer).select("path")


def append_journal(store: Store, rows: DataFrame, most: int = 400) -> None:
    """Add journal rows and keep the last ``most``."""
    store.update(lambda known: known.unionByName(rows).orderBy(F.desc("seq")).limit(most))
