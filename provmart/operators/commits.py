"""A store of Parquet tables in which a batch becomes visible whole or not at all.

Every write of a batch goes to a folder of its own, where nobody looks.  A commit is one small JSON
file that lists, for every table, the folders that make it up; it is written aside and
renamed to the next number.  Renaming fails if that number exists, so of two writers that
began from the same state one is refused, and a job that is lost anywhere before the rename
leaves the state as it was.  Readers take the newest commit and list no table folders.

The file system's rename has to refuse an existing name, as HDFS and local disks do.
"""

from __future__ import annotations

import json
import re
from contextlib import contextmanager
from typing import TYPE_CHECKING

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import work
from .latest import latest_by
from .load import Refused, blank_key, conflicts, new_rows

if TYPE_CHECKING:
    from collections.abc import Iterator

    from pyspark.sql import Column, DataFrame, SparkSession

_COMMITS = "_commits"
_NOTHING = {"version": 0, "tables": {}, "applied": {}}


class _Files:
    """The few calls of the file system that a store needs."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.jvm, self.root = spark, spark._jvm, root.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.system = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [f.getPath().getName() for f in self.system.listStatus(at)] if self.system.exists(at) else []

    def text(self, name: str) -> str:
        stream = self.system.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> None:
        """Make the file appear whole; one that exists is left and an error comes."""
        aside = f"{_COMMITS}/_{work.unique(self.spark)}"
        stream = self.system.create(self.path(aside), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.system.getUri(), self.conf)
        try:
            context.rename(self.path(aside), self.path(name), options)
        except Exception:
            self.system.delete(self.path(aside), False)
            raise

    def delete(self, name: str) -> None:
        self.system.delete(self.path(name), True)


class Store:
    """Tables under one folder; see the module."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, _Files(spark, root)

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(_COMMITS) if re.fullmatch(r"[0-9]{12}\.json", n))

    def state(self, version: int | None = None) -> dict:
        """What a commit lists; the newest if none is named."""
        found = self.versions()
        if version is None and not found:
            return json.loads(json.dumps(_NOTHING))
        if version is not None and version not in found:
            raise Refused(f"{self.files.root}: no commit {version}")
        return json.loads(self.files.text(f"{_COMMITS}/{version or found[-1]:012d}.json"))

    def table(self, name: str, state: dict) -> DataFrame | None:
        if name not in state["tables"]:
            return None
        entry = state["tables"][name]
        schema = StructType.fromJson(entry["schema"])
        paths = [f"{self.files.root}/{p}" for p, _ in self.folders(entry)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @staticmethod
    def folders(entry: dict) -> list[list]:
        """[folder, rows] of a table, whether it is a list of batches or of buckets."""
        return entry["folders"] + [b for b in entry.get("buckets", {}).values() if b[1]]

    def read(self, name: str, version: int | None = None) -> DataFrame:
        found = self.table(name, self.state(version))
        if found is None:
            raise Refused(f"{name}: no such table")
        return found

    def counts(self) -> dict[str, int]:
        """Rows of every table, from the commit alone."""
        return {n: sum(rows for _, rows in self.folders(e)) for n, e in sorted(self.state()["tables"].items())}

    @contextmanager
    def batch(self, stream: str | None = None, epoch: int = 0) -> Iterator[Batch]:
        """All writes in the block become one commit at its end; an error leaves the old state.

        A numbered batch of a stream that has been committed before is ``done`` and writes nothing.
        """
        out = Batch(self, self.state(), stream, epoch)
        try:
            yield out
            out.commit()
        except BaseException:
            for folder in out.written:
                self.files.delete(folder)
            raise

    def vacuum(self, keep: int = 2) -> int:
        """Delete commits but the newest ``keep``, and the folders that only those listed."""
        versions = self.versions()
        old, kept = versions[:-keep], versions[-keep:]
        listed = lambda some: {p for v in some for e in self.state(v)["tables"].values() for p, _ in self.folders(e)}
        gone = listed(old) - listed(kept)
        for v in old:
            self.files.delete(f"{_COMMITS}/{v:012d}.json")
        for folder in gone:
            self.files.delete(folder)
        return len(gone)


class Batch:
    """Writes that become visible together."""

    def __init__(self, store: Store, state: dict, stream: str | None, epoch: int):
        self.store, self.state, self.stream, self.epoch = store, state, stream, epoch
        self.done = stream is not None and state["applied"].get(stream, -1) >= epoch
        self.written: list[str] = []

    def read(self, name: str) -> DataFrame | None:
        """A table as it will be with what this batch has written so far."""
        return self.store.table(name, self.state)

    def _write(self, name: str, rows: DataFrame) -> tuple[str, int]:
        folder = f"{name}/{work.unique(self.store.spark)}"
        self.written.append(folder)
        path = f"{self.store.files.root}/{folder}"
        rows.write.parquet(path)
        return folder, self.store.spark.read.schema(rows.schema).parquet(path).count()

    def replace(self, name: str, rows: DataFrame) -> int:
        """Full replace; ``rows`` may read the table that it replaces."""
        if self.done:
            return 0
        folder, n = self._write(name, rows)
        self.state["tables"][name] = {"schema": rows.schema.jsonValue(), "folders": [[folder, n]]}
        return n

    def append(self, name: str, rows: DataFrame, keys: list[str], ordinal: str, hashed: str | None = None) -> int:
        """Append what is new by ``keys``: the first of the batch by ``ordinal`` wins; see ``load.append``."""
        if self.done:
            return 0
        rows = work.stored(rows, "batch")
        try:
            stored = self.read(name)
            blank_key(rows, keys)
            if hashed and (bad := conflicts(rows, keys, hashed, stored).first()):
                raise Refused(f"{name}: {', '.join(f'{k}={bad[k]}' for k in keys)}: a second fingerprint under one key")
            new = new_rows(rows, keys, ordinal, stored).select(*[c for c in rows.columns if c != ordinal])
            entry = self.state["tables"].setdefault(name, {"schema": new.schema.jsonValue(), "folders": []})
            declared = StructType.fromJson(entry["schema"])
            if [(f.name, f.dataType) for f in declared] != [(f.name, f.dataType) for f in new.schema]:
                raise Refused(f"{name}: columns {new.schema.simpleString()}, stored {declared.simpleString()}")
            folder, n = self._write(name, new)
            if n:
                entry["folders"].append([folder, n])
            return n
        finally:
            work.forget(rows)

    def keep_latest(self, name: str, rows: DataFrame, keys: list[str], order: list[Column], buckets: int = 64) -> int:
        """Fold new rows into a table that holds the latest row of every key; returns how many buckets were written again.

        A key lives in the bucket of its hash.  Only buckets that the batch touches are read and written;
        ``order`` has to be total, so that batches may come again or in any order of arrival.
        """
        if self.done:
            return 0
        place = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        rows = work.stored(rows, "batch")
        try:
            blank_key(rows, keys)
            entry = self.state["tables"].setdefault(name, {"schema": rows.schema.jsonValue(), "folders": [], "buckets": {}, "width": buckets})
            if entry.get("width") != buckets:
                raise Refused(f"{name}: {buckets} buckets, stored {entry.get('width')}")
            touched = sorted(r.b for r in rows.select(place.alias("b")).distinct().collect())  # at most ``buckets`` numbers
            if not touched:
                return 0
            held = [entry["buckets"][str(b)][0] for b in touched if entry["buckets"].get(str(b), ["", 0])[1]]
            if held:
                schema = StructType.fromJson(entry["schema"])
                rows_now = rows.unionByName(self.store.spark.read.schema(schema).parquet(*[f"{self.store.files.root}/{p}" for p in held]))
            else:
                rows_now = rows
            latest = latest_by(rows_now, keys, order).withColumn("_bucket", place)
            folder = f"{name}/{work.unique(self.store.spark)}"
            self.written.append(folder)
            path = f"{self.store.files.root}/{folder}"
            latest.repartition("_bucket").write.partitionBy("_bucket").parquet(path)
            counted = {r["_bucket"]: r["n"] for r in self.store.spark.read.parquet(path).groupBy("_bucket").agg(F.count("*").alias("n")).collect()}
            entry["buckets"] |= {str(b): [f"{folder}/_bucket={b}", n] for b, n in counted.items()}
            return len(touched)
        finally:
            work.forget(rows)

    def drop(self, name: str) -> bool:
        return self.state["tables"].pop(name, None) is not None

    def commit(self) -> None:
        if self.done:
            return
        self.state["version"] += 1
        if self.stream is not None:
            self.state["applied"][self.stream] = self.epoch
        try:
            self.store.files.put_new(f"{_COMMITS}/{self.state['version']:012d}.json", json.dumps(self.state))
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Refused(f"commit {self.state['version']}: another batch was committed meanwhile") from e
            raise
