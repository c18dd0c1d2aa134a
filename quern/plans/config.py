"""Settings from the environment and per-repository embedding settings."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import parse_bool
from quern.operators.store import upsert_columns


def _positive(env: Mapping[str, str], name: str, default: int) -> int:
    """A positive whole number of the environment; anything else gives the default."""
    text = env.get(name, "").strip()
    return int(text) if re.fullmatch(r"\d+", text) and int(text) > 0 else default


@dataclass(frozen=True)
class RetrieverConfig:
    """How many hits each signal may give, and whether the best are scored again."""

    keyword_limit: int = 20
    semantic_limit: int = 20
    symbol_limit: int = 10
    rerank: bool = False
    rerank_top_k: int = 20
    timeout_seconds: int = 5

    @property
    def total_limit(self) -> int:
        return self.keyword_limit + self.semantic_limit + self.symbol_limit

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "QUERN_") -> RetrieverConfig:
        env, d = os.environ if env is None else env, cls()
        return cls(
            _positive(env, f"{prefix}KEYWORD_LIMIT", d.keyword_limit), _positive(env, f"{prefix}SEMANTIC_LIMIT", d.semantic_limit), _positive(env, f"{prefix}SYMBOL_LIMIT", d.symbol_limit),
            parse_bool(env.get(f"{prefix}RERANK"), d.rerank), _positive(env, f"{prefix}RERANK_TOP_K", d.rerank_top_k), _positive(env, f"{prefix}TIMEOUT", d.timeout_seconds),
        )


@dataclass(frozen=True)
class IndexConfig:
    """Where an index lies and which embedder fills it."""

    store: str = ".index"
    embedder: str = "hashing"
    dimensions: int = 64
    jdbc_url: str = ""

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "QUERN_") -> IndexConfig:
        env, d = os.environ if env is None else env, cls()
        return cls(env.get(f"{prefix}STORE") or d.store, env.get(f"{prefix}EMBEDDER") or d.embedder, _positive(env, f"{prefix}DIMENSIONS", d.dimensions), env.get(f"{prefix}JDBC_URL") or d.jdbc_url)

    def masked_url(self) -> str:
        """The connection URL without its password."""
        return re.sub(r"(://[^:/@\s]*):[^@\s]*@", r"\1:***@", self.jdbc_url)


def set_repo_config(configs: DataFrame, repo_root: str, model: str, dimensions: int, now: int) -> DataFrame:
    """``repo_root, model, dimensions, created_at, updated_at`` with one repository's settings put in."""
    new = configs.sparkSession.createDataFrame([(repo_root, model, dimensions, now, now)], configs.schema)
    return upsert_columns(configs, new, ["repo_root"], ["model", "dimensions", "updated_at"])


def stale_vectors(vectors: DataFrame, configs: DataFrame) -> DataFrame:
    """Vectors whose dimensions no longer agree with the settings of their repository."""
    return vectors.join(configs.select("repo_root", F.col("dimensions").alias("__d")), "repo_root").filter(F.size("embedding") != F.col("__d")).drop("__d")
