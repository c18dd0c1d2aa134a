"""Embedding and reranking services over HTTP, called in batches from the workers."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class ServiceError(RuntimeError):
    """The service cannot be reached, or its answer is not what was asked for."""


def post(url: str, body: dict, key: str = "", timeout: float = 60.0, tries: int = 4, wait: float = 0.5) -> dict:
    """The JSON answer to a JSON request; busy and failing services are asked again, ever later."""
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    for n in range(tries):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=timeout) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as error:
            if error.code not in (408, 429) and error.code < 500:
                raise ServiceError(f"{url}: {error.code}") from error
            last = error
        except (urllib.error.URLError, TimeoutError, ConnectionError, ValueError) as error:
            last = error
        if n + 1 < tries:
            time.sleep(wait * 2**n)
    raise ServiceError(f"{url}: {last}") from last


class RemoteEmbedder:
    """An ``Embedder`` whose vectors come from a service.

    ``form`` tells its dialect: ``data`` answers ``{"data": [{"index", "embedding"}]}``, ``vectors``
    answers ``{"embeddings": [...]}``; both are asked with ``{"model", "input"}``.
    """

    def __init__(self, url: str, model: str, dimensions: int, form: str = "data", key: str = "", batch: int = 64, **options):
        if form not in ("data", "vectors"):
            raise ValueError("form must be data or vectors")
        self.url, self.name, self.dimensions, self.form, self.key, self.batch, self.options = url, model, dimensions, form, key, batch, options

    def available(self) -> bool:
        """Whether the service answers with vectors of the right length."""
        try:
            return self.embed(["x"]).shape == (1, self.dimensions)
        except ServiceError:
            return False

    def embed(self, texts: list[str]) -> np.ndarray:
        parts = [self._some(texts[n : n + self.batch]) for n in range(0, len(texts), self.batch)]
        return np.concatenate(parts) if parts else np.empty((0, self.dimensions), np.float32)

    def _some(self, texts: list[str]) -> np.ndarray:
        answer = post(self.url, {"model": self.name, "input": texts}, self.key, **self.options)
        try:
            rows = answer["embeddings"] if self.form == "vectors" else [d["embedding"] for d in sorted(answer["data"], key=lambda d: d["index"])]
            out = np.asarray(rows, np.float32)
        except (KeyError, TypeError, ValueError) as error:
            raise ServiceError(f"{self.url}: no vectors") from error
        if out.shape != (len(texts), self.dimensions):
            raise ServiceError(f"{self.url}: {out.shape} instead of {(len(texts), self.dimensions)}")
        return out


def remote_scores(hits: DataFrame, query: str, url: str, model: str, id_col: str = "id", text_col: str = "text", key: str = "", batch: int = 32, **options) -> DataFrame:
    """``id, rerank_score`` of a bounded list of hits, for ``fusion.rerank``, from a service that answers
    ``{"results": [{"index", "relevance_score"}]}``; texts it leaves out get no row."""
    kind = hits.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            ids, texts = rows[id_col].tolist(), rows[text_col].fillna("").tolist()
            scored = []
            for n in range(0, len(ids), batch):
                answer = post(url, {"model": model, "query": query, "documents": texts[n : n + batch]}, key, **options)
                scored += [(ids[n + r["index"]], float(r["relevance_score"])) for r in answer.get("results", [])]
            yield pd.DataFrame(scored, columns=["id", "rerank_score"])

    return hits.select(id_col, text_col).mapInPandas(run, f"id {kind}, rerank_score double")
