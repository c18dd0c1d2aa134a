"""Immutable table versions with deletion vectors, and consumers that process each change once.

A table is a folder of immutable Parquet files and of manifests ``_manifests/v<number>.json``. A
manifest lists the data files of its version and, per file, its deletion vector (a folder of Parquet
rows of positions that no longer count). A commit writes its manifest under another name and renames
it to one that must not exist yet: of two concurrent commits one fails, and a crash leaves either no
version or a whole one. A manifest that is no whole JSON text is no version, its number is given
again. All file access goes through Hadoop's FileSystem, so any shared store whose rename does not
overwrite works.

``changes`` diffs two versions: added files give inserts, removed files deletes (less what was
deleted before), files of both versions with a changed deletion vector deletes or re-inserts.
``process`` applies a function to the changes since the version that the sink's last commit names,
and saves the new version in the same commit as the output: after a crash the next run sees the
old version and none of the lost output, so nothing is skipped or done twice.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.runtime import cut_table


class CommitConflict(RuntimeError):
    """Another writer committed the same version first."""


class VersionedTable:
    """A versioned table in a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _stored(self, version: int) -> dict | None:
        """The manifest of a version; None if there is none or it is torn."""
        target = self._path(f"{self.root}/_manifests/v{version:012d}.json")
        if not self._fs.exists(target):
            return None
        stream = self._fs.open(target)
        try:
            found = json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            return None
        finally:
            stream.close()
        return found if isinstance(found, dict) and "files" in found else None

    def version(self) -> int:
        """The newest version, 0 for a table without any."""
        folder = self._path(f"{self.root}/_manifests")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        numbers = sorted((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), reverse=True)
        return next((n for n in numbers if self._stored(n) is not None), 0)

    def manifest(self, version: int | None = None) -> dict:
        """``{"files": {path: deletion vector or None}, "meta": {...}}`` of a version."""
        version = self.version() if version is None else version
        if version == 0:
            return {"files": {}, "meta": {}}
        found = self._stored(version)
        if found is None:
            raise ValueError(f"no version {version} of {self.root}")
        return found

    def _commit(self, version: int, manifest: dict) -> int:
        target, written = (self._path(f"{self.root}/_manifests/{n}") for n in (f"v{version:012d}.json", f".{uuid.uuid4().hex}"))
        if self._fs.exists(target) and self._stored(version) is None:
            self._fs.delete(target, False)  # torn: no commit of ours leaves one
        out = self._fs.create(written, False)
        try:
            out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            out.close()
        try:
            self._rename(written, target)
        except Exception as error:
            raise CommitConflict(f"version {version} exists already") from error
        finally:
            self._fs.delete(written, False)
        return version

    def _rename(self, source, target) -> None:
        """Rename without overwriting, in one step."""
        if self._fs.getUri().getScheme() == "file":
            # a local rename overwrites, a link does not
            os.link(source.toUri().getPath(), target.toUri().getPath())
            return
        jvm = self.spark._jvm
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(source, target, none)

    def _write(self, df: DataFrame, kind: str) -> list[str]:
        folder = f"{self.root}/{kind}/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return sorted(f"{folder}/{s.getPath().getName()}" for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().endswith(".parquet"))

    def _positions(self, files: list[str]) -> DataFrame:
        """Rows of data files with ``_file`` and ``_row``."""
        return self.spark.read.parquet(*files).select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("_file"), F.col("_metadata.row_index").alias("_row"))

    def _deleted(self, files: dict[str, str | None]) -> DataFrame | None:
        """``_file, _row`` of the deletion vectors of files."""
        vectors = sorted({v for v in files.values() if v})
        if not vectors:
            return None
        # a folder also holds vectors of files that have a newer one since; the manifest names as many files
        names = self.spark.createDataFrame([(f.rsplit("/", 1)[-1],) for f, v in files.items() if v], "_file string")
        return self.spark.read.parquet(*vectors).join(names, "_file", "left_semi").select("_file", "_row")

    def _alive(self, files: dict[str, str | None]) -> DataFrame | None:
        """Rows of the files without those their deletion vectors name."""
        if not files:
            return None
        rows, dead = self._positions(list(files)), self._deleted(files)
        return rows if dead is None else rows.join(dead, ["_file", "_row"], "left_anti")

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version; None if it has no files."""
        rows = self._alive(self.manifest(version)["files"])
        return None if rows is None else rows.drop("_file", "_row")

    def _change(self, hits: DataFrame | None, fresh: DataFrame | None, meta: dict | None, base: int, touched: set[str] | None = None) -> int:
        """Commit a version without the rows at ``hits`` (``_file, _row``), which lie in the files
        ``touched``, and with those of ``fresh``."""
        old = self.manifest(base)
        files = dict(old["files"])
        if hits is not None:
            if touched is None:
                touched = {r["_file"] for r in hits.select("_file").distinct().collect()}  # of the files the manifest names
            if touched:
                before = self._deleted({f: v for f, v in files.items() if f.rsplit("/", 1)[-1] in touched})
                folder = f"{self.root}/deleted/{uuid.uuid4().hex}"
                (hits if before is None else hits.unionByName(before)).write.parquet(folder)
                files = {f: folder if f.rsplit("/", 1)[-1] in touched else v for f, v in files.items()}
        if fresh is not None:
            files |= dict.fromkeys(self._write(fresh, "data"))
        return self._commit(base + 1, {"files": files, "meta": old["meta"] | (meta or {})})

    def append(self, df: DataFrame, meta: dict | None = None, base: int | None = None) -> int:
        """Commit a version with the rows of ``df`` added; ``meta`` is kept with it."""
        return self._change(None, df, meta, self.version() if base is None else base)

    def mark(self, meta: dict, base: int | None = None) -> int:
        """Commit a version with the same rows and more ``meta``."""
        return self._change(None, None, meta, self.version() if base is None else base)

    def delete(self, condition: str, meta: dict | None = None) -> int:
        """Commit a version without the rows that meet a SQL condition, by deletion vectors."""
        base = self.version()
        alive = self._alive(self.manifest(base)["files"])
        return base if alive is None else self._change(alive.filter(condition).select("_file", "_row"), None, meta, base)

    def exchange(self, gone: DataFrame, keys: list[str], fresh: DataFrame | None, meta: dict | None = None, base: int | None = None) -> int:
        """Commit a version without the rows whose key is in ``gone`` and with those of ``fresh``."""
        base = self.version() if base is None else base
        alive = self._alive(self.manifest(base)["files"])
        hits = None if alive is None else alive.join(gone.select(*keys).distinct(), keys, "left_semi").select("_file", "_row")
        return self._change(hits, fresh, meta, base)

    def replace(self, df: DataFrame, keys: list[str], meta: dict | None = None) -> int:
        """Commit a version that holds the rows of ``df``, one per key, keeping the stored rows that are the same.

        Rows that differ or are gone get deletion vectors, new and changed ones come in added files,
        so ``changes`` reads just these. Rows with a null key are dropped. Without any difference
        there is no new version.
        """
        base = self.version()
        df = df.na.drop(subset=keys)
        alive = self._alive(self.manifest(base)["files"])
        if alive is None:
            return self.append(df, meta, base)
        rest = [c for c in df.columns if c not in keys]
        old = alive.select(*keys, F.struct(*rest).alias("_old"), "_file", "_row")
        joined = old.join(df.select(*keys, F.struct(*rest).alias("_new")), keys, "full")
        differ = cut_table(joined.filter(~F.col("_old").eqNullSafe(F.col("_new"))).drop("_old"), "differ")
        counts = {r["_file"]: r["n"] for r in differ.groupBy("_file").agg(F.count("_new").alias("n")).collect()}  # one row per touched file
        if not counts:
            return base
        hits, fresh = differ.filter("_file is not null").select("_file", "_row"), differ.filter("_new is not null").select(*keys, "_new.*").select(*df.columns)
        return self._change(hits, fresh if any(counts.values()) else None, meta, base, counts.keys() - {None})

    def rewrite(self, df: DataFrame, meta: dict | None = None) -> int:
        """Commit a version that consists of the rows of ``df`` alone."""
        base = self.version()
        return self._commit(base + 1, {"files": dict.fromkeys(self._write(df, "data")), "meta": self.manifest(base)["meta"] | (meta or {})})

    def changes(self, since: int, until: int | None = None) -> DataFrame | None:
        """Rows with ``_change`` (``insert``, ``delete``) between two versions; None without changes."""
        old, new = self.manifest(since)["files"], self.manifest(until)["files"]
        parts = []
        added = {f: v for f, v in new.items() if f not in old}
        removed = {f: v for f, v in old.items() if f not in new}
        for files, change in ((added, "insert"), (removed, "delete")):
            rows = self._alive(files)
            if rows is not None:
                parts.append(rows.withColumn("_change", F.lit(change)))
        differ = [f for f in new if f in old and new[f] != old[f]]
        if differ:
            was, now = self._deleted({f: old[f] for f in differ}), self._deleted({f: new[f] for f in differ})
            rows = self._positions(differ)
            for plus, minus, change in ((now, was, "delete"), (was, now, "insert")):
                if plus is not None:
                    only = plus if minus is None else plus.join(minus, ["_file", "_row"], "left_anti")
                    parts.append(rows.join(only, ["_file", "_row"], "left_semi").withColumn("_change", F.lit(change)))
        if not parts:
            return None
        return reduce(DataFrame.unionByName, parts).drop("_file", "_row")


def net_changes(delta: DataFrame, keys: list[str], signature: list[str] | None = None) -> DataFrame:
    """``keys`` + ``change`` (``added``, ``modified``, ``deleted``) of every key in the changes between two versions.

    A key whose row was deleted and inserted is modified, unless the columns ``signature`` of both
    rows are the same. Rows are aggregated before they move.
    """
    inserted, deleted = (F.max(F.col("_change") == c) for c in ("insert", "delete"))
    state = lambda c: F.max(F.when(F.col("_change") == c, F.struct(*signature)))
    same = state("insert").eqNullSafe(state("delete")) if signature else F.lit(False)
    kind = F.when(inserted & deleted, F.when(same, None).otherwise("modified")).when(inserted, "added").otherwise("deleted")
    return delta.groupBy(*keys).agg(kind.alias("change")).filter("change is not null")


def process(source: VersionedTable, sink: VersionedTable, transform: Callable[[DataFrame], DataFrame | None], name: str = "source", keys: list[str] | None = None, again: bool = False) -> int | None:
    """Apply ``transform`` to the changes of ``source`` the sink has not seen, and append the result.

    With ``keys`` the sink's rows of changed keys are removed in the same commit; ``again`` starts
    from nothing and replaces all of the sink's rows. The processed version is saved in the commit
    of the output. Returns the processed version, or None if there was nothing new. A concurrent
    run of the same consumer loses the commit and changes nothing.
    """
    base = sink.version()
    seen = 0 if again else sink.manifest(base)["meta"].get(f"processed:{name}", 0)
    until = source.version()
    if until == seen:
        return None
    delta = source.changes(seen, until)
    meta = {f"processed:{name}": until}
    fresh = None if delta is None else transform(delta)
    if again:
        sink._commit(base + 1, {"files": {} if fresh is None else dict.fromkeys(sink._write(fresh, "data")), "meta": sink.manifest(base)["meta"] | meta})
    elif keys and delta is not None:
        sink.exchange(delta, keys, fresh, meta, base)
    else:
        sink._change(None, fresh, meta, base)
    return until
