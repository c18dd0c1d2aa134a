"""Subject areas of documents (problem 10).

Method: averaged word and subword embeddings with independent logistic outputs. A sentence is the
mean of the embeddings of its words and of their character n-grams (hashed into ``BUCKETS`` rows);
one logistic output per area says whether the sentence deals with it. Training is synchronous:
each step broadcasts the parameters, every partition returns the gradient of its sentences (only
the touched embedding rows), the driver adds them and makes one Adam step.

Labels are per text, decisions per sentence. Every sentence first carries the label of its text;
sentences of stock phrases occur under all labels, learn a low score for each and are set to "no
area" in a second pass. A bounded, hash-chosen sample of documents that the first model finds
clear then takes part as weakly labelled text, which teaches the stock phrases and the vocabulary
of the corpus. All documents are scored by one map over whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.runtime import cut_lineage, hash_sample, spread

BUCKETS, DIM = 1 << 15, 16
LONGEST_CODE = 240
_FENCE = re.compile(r"(?ms)^[^\w\n`]*```.*?^[^\w\n`]*```")
#: A fence that is never closed ends before the next paragraph of prose.
_OPEN_FENCE = re.compile(r"(?ms)^[^\w\n`]*```.*?(?:\n[ \t]*\n(?=[^\n{}=;]{20,}[.?!][ \t]*$)|\Z)")
_SPAN = re.compile(r"`[^`\n]*`")
_COMMIT = re.compile(r"^\W*[a-z]+(?:\([^)\s]*\))?!?:(?= )")
_CODE = re.compile(r"[{}=]|;\s*$|\w\(|::|->")
_END = re.compile(r"(?<=[.?!])\s+")
_WORD = re.compile(r"(?<![\w`])[^\W\d_]{2,}(?![\w`])")
_CAMEL = re.compile(r"[a-zß-ÿ][A-Z]")


def sentences(text: str | None, least: int = 3) -> list[list[str]]:
    """The prose sentences of a text as lists of words: no code lines, fences, spans or identifiers.

    Of lines too long for code only the sentences that look like code are left out.
    """
    out = []
    text = text or ""
    if "```" in text:
        text = _OPEN_FENCE.sub("\n", _FENCE.sub("\n", text))
    for line in text.split("\n"):
        if "`" in line:
            line = _SPAN.sub(" ", line)
        line = _COMMIT.sub("", line)
        long = len(line) > LONGEST_CODE
        if not long and _CODE.search(line):
            continue
        for part in _END.split(line):
            if long and _CODE.search(part):
                continue
            words = [w if w.islower() else w.lower() for w in _WORD.findall(part) if w.islower() or not _CAMEL.search(w)]
            if len(words) >= least:
                out.append(words)
    return out


def features(word: str) -> np.ndarray:
    """Hash buckets of a word and of its character 4-, 5- and 6-grams."""
    marked = f"<{word}>"
    grams = [word, *(f"#{marked[i : i + n]}" for n in (4, 5, 6) for i in range(len(marked) - n + 1))]
    return np.array([zlib.crc32(g.encode()) % BUCKETS for g in grams], np.int32)


class Model:
    """Embedding matrix, output weights and biases, with the names of the areas."""

    def __init__(self, areas: list[str], seed: int = 0):
        r = np.random.default_rng(seed)
        self.areas = areas
        self.params = [r.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), r.normal(0, 0.3, (DIM, len(areas))).astype(np.float32), np.full(len(areas), -3, np.float32)]
        self._forget()

    def _forget(self) -> None:
        self._words: dict[str, int] = {}
        self._sums = np.empty((1024, DIM + 1), np.float32)

    def __getstate__(self):
        return {"areas": self.areas, "params": self.params}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def probabilities(self, sents: list[list[str]]) -> np.ndarray:
        """(sentence, area) probabilities; sums of a word's embeddings are kept for later texts."""
        if not sents:
            return np.empty((0, len(self.areas)))
        if len(self._words) > 300_000:
            self._forget()
        known, number = self._words, []
        for words in sents:
            for w in words:
                n = known.get(w)
                if n is None:
                    n = known[w] = len(known)
                    if n == len(self._sums):
                        self._sums = np.concatenate([self._sums, np.empty_like(self._sums)])
                    ids = features(w)
                    self._sums[n, :-1], self._sums[n, -1] = self.params[0][ids].sum(0), len(ids)
                number.append(n)
        starts = np.cumsum([0, *map(len, sents[:-1])])
        total = np.add.reduceat(self._sums[number], starts, axis=0)
        return _sigmoid(total[:, :-1] / total[:, -1:] @ self.params[1] + self.params[2])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class _Packed(NamedTuple):
    """Sentences of a partition: features of its words, words of its sentences, targets, weights."""

    fids: np.ndarray
    flens: np.ndarray
    wids: np.ndarray
    slens: np.ndarray
    target: np.ndarray
    weight: np.ndarray


def _starts(lens: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lens)[:-1]))


def _hidden(blob: _Packed, embedding: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean embedding of every sentence, and its number of features; words are summed once."""
    words = np.add.reduceat(embedding[blob.fids], _starts(blob.flens), axis=0)
    at = _starts(blob.slens)
    count = np.add.reduceat(blob.flens[blob.wids], at)
    return np.add.reduceat(words[blob.wids], at, axis=0) / count[:, None], count


def _summed(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of rows by key, for the keys in ascending order."""
    order = np.argsort(keys, kind="stable")
    rows, first = np.unique(keys[order], return_index=True)
    return rows, np.add.reduceat(values[order], first, axis=0)


def _gradient(blob: _Packed, params: list[np.ndarray], total: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    hidden, count = _hidden(blob, params[0])
    error = (_sigmoid(hidden @ params[1] + params[2]) - blob.target) * (blob.weight / total)[:, None]
    back = error @ params[1].T / count[:, None]
    _, words = _summed(np.repeat(back, blob.slens, axis=0), blob.wids)  # every word of the partition occurs
    rows, embedding = _summed(np.repeat(words, blob.flens, axis=0), blob.fids)
    return rows, embedding, hidden.T @ error, error.sum(0)


def _unpack(row, areas: int) -> _Packed:
    return _Packed(*(np.frombuffer(getattr(row, c), np.int32) for c in ("fids", "flens", "wids", "slens")), np.frombuffer(row.target, np.float32).reshape(-1, areas), np.frombuffer(row.weight, np.float32))


_BLOB = "part int, fids binary, flens binary, wids binary, slens binary, target binary, weight binary"


def _packed(weak: DataFrame, areas: list[str], parts: int) -> DataFrame:
    """Sentences with weak area labels as one binary row per partition.

    ``weak`` has ``sentence`` (words joined by blanks), ``area``, ``weight``; equal sentences are
    merged, with their labels as shares.
    """
    number = {a: n for n, a in enumerate(areas)}
    merged = weak.groupBy("sentence", "area").agg(F.sum("weight").alias("weight")).groupBy("sentence").agg(F.collect_list(F.struct("area", "weight")).alias("labels"))
    placed = merged.withColumn("part", F.pmod(F.xxhash64("sentence"), F.lit(parts)).cast("int"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("sentence")
        split = [s.split(" ") for s in group["sentence"]]
        words = {w: n for n, w in enumerate(sorted({w for s in split for w in s}))}
        feats = [features(w) for w in words]
        target = np.zeros((len(group), len(areas)), np.float32)
        for n, labels in enumerate(group["labels"]):
            for label in labels:
                target[n, number[label["area"]]] += label["weight"]
        weight = target.sum(1)
        arrays = {"fids": np.concatenate(feats), "flens": [len(f) for f in feats], "wids": [words[w] for s in split for w in s], "slens": [len(s) for s in split]}
        row = {c: [np.asarray(v, np.int32).tobytes()] for c, v in arrays.items()}
        return pd.DataFrame({"part": [group["part"].iloc[0]], **row, "target": [(target / weight[:, None]).tobytes()], "weight": [weight.tobytes()]})

    # every part a partition of its own: AQE would merge them, and with them the steps' work
    apart = placed.repartitionByRange(parts, "part")
    return cut_lineage(apart.groupBy("part").applyInPandas(pack, _BLOB))


def _descend(packed: DataFrame, model: Model, steps: int, rate: float) -> None:
    """Synchronous full-batch Adam: one gradient per partition and step, added on the driver."""
    context, areas = packed.sparkSession.sparkContext, len(model.areas)
    weights = [float(np.frombuffer(r.weight, np.float32).sum()) for r in packed.select("weight").collect()]  # one row per part
    total = sum(weights)
    mean = [np.zeros_like(p) for p in model.params]
    square = [np.zeros_like(p) for p in model.params]
    # planned once for all steps, each of which is one small job with a task for every part
    parts = packed.rdd.map(lambda row: (row.part, row)).partitionBy(len(weights), int).values()
    for step in range(1, steps + 1):
        sent = context.broadcast(model.params)

        def gradients(rows: Iterator, sent=sent) -> Iterator[tuple]:
            for row in rows:
                yield (row.part, *_gradient(_unpack(row, areas), sent.value, total))

        summed = [np.zeros_like(p) for p in model.params]
        for _, rows, e, w, b in sorted(parts.mapPartitions(gradients).collect(), key=lambda r: r[0]):
            summed[0][rows] += e
            summed[1] += w
            summed[2] += b
        for p, g, m, v in zip(model.params, summed, mean, square, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        sent.destroy()


def _settled(packed: DataFrame, model: Model) -> DataFrame:
    """The same sentences with the areas the model now gives them, or none."""
    spark, areas = packed.sparkSession, len(model.areas)
    sent = spark.sparkContext.broadcast(model.params)

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                hidden, _ = _hidden(_unpack(row, areas), sent.value[0])
                p = _sigmoid(hidden @ sent.value[1] + sent.value[2])
                target = ((p > 0.4) & (p == p.max(1, keepdims=True))).astype(np.float32)
                yield pd.DataFrame({c: [target.tobytes() if c == "target" else getattr(row, c)] for c in batch.columns})

    return cut_lineage(packed.mapInPandas(settle, _BLOB))


def _fit(weak: DataFrame, areas: list[str], parts: int, steps: int, rate: float, settle: bool = True) -> Model:
    packed = _packed(weak, areas, parts)
    model = Model(areas)
    _descend(packed, model, steps, rate)
    if not settle:
        return model
    packed = _settled(packed, model)
    model = Model(areas)
    _descend(packed, model, steps, rate)
    return model


def _shares(sents: list[list[str]], model: Model) -> tuple[np.ndarray, int, np.ndarray]:
    """Share of each area in the sentences that deal with any, their number, and the soft scores."""
    p = model.probabilities(sents)
    if not len(p):
        return np.zeros(len(model.areas)), 0, np.zeros(len(model.areas))
    own = (p >= 0.5) & (p == p.max(1, keepdims=True))
    any_area = int((p >= 0.5).any(1).sum())
    return own.sum(0) / max(1, any_area), any_area, p.sum(0)


def train_areas(
    examples: DataFrame,
    documents: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_documents: int = 4_000,
    example_weight: float = 3.0,
    parts: int = 4,
    steps: int = 35,
    rate: float = 0.05,
) -> Model:
    """A model of the areas in ``examples`` (``subject``, ``text``), refined on clear documents.

    About ``sample_documents`` documents, those with the smallest hashes of their ids, take part
    as weakly labelled text. Examples with a null subject or text teach nothing.
    """
    usable = examples.filter("subject is not null and text is not null")
    areas = sorted(r[0] for r in usable.select("subject").distinct().collect())
    if not areas:
        raise ValueError("no labelled example")

    def labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(" ".join(s), a, example_weight) for a, t in zip(batch["subject"], batch["text"], strict=True) for s in sentences(t)], columns=["sentence", "area", "weight"])

    schema = "sentence string, area string, weight double"
    weak = cut_lineage(usable.select("subject", "text").mapInPandas(labelled, schema))
    refine = documents is not None and sample_documents > 0
    model = _fit(weak, areas, parts, steps, rate, settle=not refine)
    if not refine:
        return model
    sample = hash_sample(documents.select(id_col, text_col).filter(F.col(text_col).isNotNull()), id_col, sample_documents)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def clear(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch[text_col]:
                sents = sentences(text)
                share, any_area, _ = _shares(sents, sent.value)
                if any_area >= 2 and share.max() >= 0.75:
                    rows += [(" ".join(s), areas[int(share.argmax())], 1.0) for s in sents]
            yield pd.DataFrame(rows, columns=["sentence", "area", "weight"])

    return _fit(weak.unionByName(sample.repartition(parts).mapInPandas(clear, schema)), areas, parts, steps, rate)


def document_areas(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least_share: float = 0.25) -> DataFrame:
    """``id, subject, share, sentences``: every area that carries at least ``least_share`` of the
    sentences that deal with any area.

    Texts in which no sentence does get the area with the highest summed score over all their
    words, so every document has at least one area; ties go to the first name. Null and empty texts
    score like a text without words (the biases). Repeated documents are scored each,
    documents without an id are left out.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for batch in batches:
            rows = []
            for key, text in zip(batch[id_col].tolist(), batch[text_col].tolist(), strict=True):
                share, any_area, soft = _shares(sentences(text), model)
                chosen = np.flatnonzero(share >= least_share - 1e-9)
                if not len(chosen):
                    loose = [w for w in _WORD.findall((text or "").lower())]
                    soft = soft + (model.probabilities([[w] for w in loose]).sum(0) if loose else _sigmoid(model.params[2]))
                    chosen = [int(soft.argmax())]
                rows += [(key, model.areas[c], float(share[c]), any_area) for c in chosen]
            yield pd.DataFrame(rows, columns=[id_col, "subject", "share", "sentences"])

    return spread(documents.select(id_col, text_col).filter(F.col(id_col).isNotNull())).mapInPandas(score, f"{id_col} {kind}, subject string, share double, sentences int")


def subjects_of(spark: SparkSession, documents: DataFrame, examples: DataFrame) -> DataFrame:
    """Train on the examples and score every document; without any labelled example no document has an area."""
    if examples.filter("subject is not null and text is not null").isEmpty():
        kind = documents.schema["doc_id"].dataType.simpleString()
        return spark.createDataFrame([], f"doc_id {kind}, subject string, share double, sentences int")
    return document_areas(documents, train_areas(examples, documents))
