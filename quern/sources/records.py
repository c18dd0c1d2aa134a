"""Small record files: evaluation cases, tag dumps, project registry and configuration."""

from __future__ import annotations

import json
import os
import tempfile
import time
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.languages import normalize_kind
from quern.operators.search import extract_name, relative_path

CASES = "id string, category string, description string, prompt string, difficulty string, ground_truth struct<files: array<string>, symbols: array<string>, lines: map<string, array<int>>, content: array<string>>"
TAGS = "_type string, name string, path string, line int, kind string, language string, pattern string, scope string, scopeKind string, signature string"


def read_cases(spark: SparkSession, path: str, categories: list[str] | None = None, ids: list[str] | None = None) -> DataFrame:
    """Cases of JSON lines files; blank and ``//`` lines are skipped, malformed lines give null ids."""
    lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.startswith(F.ltrim("value"), F.lit("//")))
    cases = lines.select(F.from_json("value", CASES).alias("c")).select("c.*")
    if categories:
        cases = cases.filter(F.col("category").isin(*categories))
    return cases.filter(F.col("id").isin(*ids)) if ids else cases


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """Symbols of a tag dump in JSON lines; other entries and malformed lines are skipped."""
    tags = spark.read.schema(TAGS).json(path).filter("_type = 'tag' and name is not null and path is not null")
    scope = F.when((F.col("scopeKind") != "") & (F.col("scope") != ""), F.concat_ws(":", "scopeKind", "scope")).otherwise(F.col("scope"))
    return tags.select("name", "kind", "path", "line", "language", "pattern", scope.alias("scope"), F.lit(None).cast("string").alias("signature"))


MATCHES = "text string, file string, language string, range struct<start: struct<line: int, column: int>>, metaVariables struct<single: map<string, struct<text: string>>>"


def read_matches(spark: SparkSession, path: str, kind: str, root: str = "") -> DataFrame:
    """Symbols of a structural search's dump in JSON lines, all of one kind; malformed lines are skipped.

    The name is that of the variable NAME, else what the first line of the match starts with.
    """
    found = spark.read.schema(MATCHES).json(path).filter("text is not null and file is not null")
    named = F.col("metaVariables.single")["NAME"]["text"]
    name = F.coalesce(F.when(named != "", named), extract_name(F.element_at(F.split("text", "\n"), 1)))
    return found.select(name.alias("name"), normalize_kind(F.lit(kind)).alias("kind"), relative_path(F.col("file"), root).alias("path"), F.col("range.start.line").alias("line"), F.lower("language").alias("language"), F.trim("text").alias("pattern"))


def write_json(path: str, value: object) -> None:
    """Write a JSON file atomically."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=target.name)
    with os.fdopen(handle, "w") as out:
        json.dump(value, out, indent=2, sort_keys=True)
    os.replace(name, target)


@dataclass
class Registry:
    """The projects that are indexed and watched: control plane, one small JSON file."""

    path: str
    settings: dict = field(default_factory=lambda: {"auto_watch": True, "debounce_ms": 500, "max_projects": 50})
    projects: list[dict] = field(default_factory=list)

    @classmethod
    def open(cls, path: str) -> Registry:
        registry = cls(path)
        if Path(path).is_file():
            stored = json.loads(Path(path).read_text())
            registry.settings |= stored.get("settings", {})
            registry.projects = stored.get("projects", [])
        return registry

    def _save(self) -> None:
        write_json(self.path, {"version": 1, "settings": self.settings, "projects": self.projects})

    def get(self, project: str) -> dict:
        full = os.path.abspath(project)
        for p in self.projects:
            if p["path"] == full:
                return p
        raise KeyError(full)

    def add(self, project: str) -> None:
        full = os.path.abspath(project)
        if any(p["path"] == full for p in self.projects):
            return
        if len(self.projects) >= self.settings["max_projects"]:
            raise ValueError("too many projects")
        self.projects.append({"path": full, "name": os.path.basename(full), "added_at": int(time.time()), "last_indexed": None, "index_stats": {"symbols": 0, "embeddings": 0, "db_size_bytes": 0}, "watch_enabled": bool(self.settings["auto_watch"])})
        self._save()

    def remove(self, project: str) -> None:
        self.projects.remove(self.get(project))
        self._save()

    def update(self, project: str, stats: dict | None = None, indexed: int | None = None, watch: bool | None = None) -> None:
        p = self.get(project)
        p["index_stats"] |= stats or {}
        if indexed is not None:
            p["last_indexed"] = indexed
        if watch is not None:
            p["watch_enabled"] = watch
        self._save()

    def watched(self) -> list[dict]:
        return [p for p in self.projects if p["watch_enabled"]]

    def totals(self) -> dict:
        return {k: sum(p["index_stats"].get(k, 0) for p in self.projects) for k in ("symbols", "embeddings", "db_size_bytes")}

    def discover(self, root: str, marker: str = ".index", depth: int = 3, register: bool = False) -> tuple[list[str], list[str]]:
        """(registered, new) directories below ``root`` that hold an index directory."""
        base = Path(root).resolve()
        known = {p["path"] for p in self.projects}
        found = sorted({str(p.parent) for n in range(depth + 1) for p in base.glob("*/" * n + marker) if p.is_dir()})
        new = [f for f in found if f not in known]
        if register:
            for f in new:
                self.add(f)
        return [f for f in found if f in known], new


@dataclass(frozen=True)
class IndexSettings:
    """Parameters of an approximate index, with the usual presets."""

    m: int = 16
    ef_construction: int = 64
    ef_search: int = 40
    metric: str = "cosine"

    PRESETS = {"default": (16, 64, 40), "high_recall": (32, 200, 100), "fast": (12, 64, 20)}

    @classmethod
    def preset(cls, name: str) -> IndexSettings:
        return cls(*cls.PRESETS[name])

    def validate(self) -> None:
        if not 2 <= self.m <= 100:
            raise ValueError("m must be in 2..100")
        if not self.m <= self.ef_construction <= 2000 or not 1 <= self.ef_search <= 2000:
            raise ValueError("ef_construction must be in m..2000 and ef_search in 1..2000")
        if self.metric not in ("cosine", "euclidean", "dot"):
            raise ValueError("unknown metric")

    def memory_bytes(self, vectors: int, dimensions: int) -> int:
        return vectors * dimensions * 4 + vectors * self.m * 2 * 8

    def build_seconds(self, vectors: int, dimensions: int) -> float:
        return vectors / (100 / (self.ef_construction / 64 * dimensions / 768))
