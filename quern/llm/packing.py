"""Filling fixed-capacity containers with items of varying length (problem 8).

Method: sum-of-squares online packing. With N(h) open containers filled to level h, an item goes
to the level (or a new container) that minimises the sum of N(h)^2 over all levels, which keeps
the levels evenly populated so that later items find a fitting gap. A level array holds N; each
placement scores all levels at once with numpy.

Items are dealt to shards of about ``shard_items`` by a hash of their id, so no task gathers more
than a bounded number of (id, size) pairs whatever the corpus; texts stay in the map stage that
counts their tokens. A second round repacks the containers a shard left badly filled, pooled over
``pool`` shards, which removes the waste at the shards' ends.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.runtime import cut_lineage, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to the public byte-level BPE vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(texts: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``id, tokens``: the length of every text in tokens; null and empty texts have 0, null ids are left out."""
    kind = texts.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(tokenizer)
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch[text_col]]
            yield pd.DataFrame({id_col: batch[id_col], "tokens": np.array(sizes, np.int64)})

    return spread(texts.select(id_col, text_col).filter(F.col(id_col).isNotNull())).mapInPandas(count, f"{id_col} {kind}, tokens bigint")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of each item, placed in the given order; sizes must be in 1..capacity."""
    open_at = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    where = np.empty(len(sizes), np.int64)
    made = 0
    for n, size in enumerate(sizes.tolist()):
        top = capacity - size
        # moving a container from level h to h + size changes the sum of squares by
        # 2 N(h + size) + 1 - (2 N(h) - 1); a full container leaves the sum
        gain = 2 * open_at[size:].copy() + 1
        gain[top] = 0
        gain[1:] -= 2 * open_at[1 : top + 1] - 1
        gain[1:][open_at[1 : top + 1] == 0] = np.iinfo(np.int64).max
        # of equal levels the fullest
        level = top - int(np.argmin(gain[::-1]))
        if level == 0:
            box, made = made, made + 1
        else:
            box = stacks[level].pop()
            open_at[level] -= 1
        where[n] = box
        if level < top:
            stacks[level + size].append(box)
            open_at[level + size] += 1
    return where


def pieces_of(size: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of an item: itself, or full containers and a rest if it exceeds the capacity."""
    if size <= capacity:
        return [(0, size)]
    return [(start, min(capacity, size - start)) for start in range(0, size, capacity)]


def _pack(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, capacity: int, separator: int) -> np.ndarray:
    """Containers of pieces: a separator before every piece but the first is the same as one after each."""
    # online: an order that has nothing to do with the sizes, the same in every run
    order = np.random.default_rng(len(sizes)).permutation(np.lexsort((starts, ids)))
    # every item carries one separator and the container has room for one more
    where = np.empty(len(sizes), np.int64)
    where[order] = sum_of_squares(sizes[order] + separator, capacity + separator)
    return where


def pack_items(
    sizes: DataFrame,
    capacities: DataFrame,
    id_col: str,
    shard_items: int = 20_000,
    pool: int = 16,
    well_filled: float = 0.98,
) -> DataFrame:
    """``pack_name, container, id, piece, start_token, tokens``: every item once per capacity, whole
    unless it exceeds the capacity.

    ``sizes`` has ``id_col`` and ``tokens``, ``capacities`` has ``pack_name, capacity_tokens,
    separator_tokens`` (a small table of settings; rows with a null or non-positive capacity are no
    containers, a null separator is 0). Items without tokens are laid too (they take only a
    separator); null ids form no item. Within a shard items come in a fixed, size-blind order. ``container``
    is unique within its pack. Extra columns are ignored.
    """
    kind = sizes.schema[id_col].dataType.simpleString()
    packs = capacities.select("pack_name", F.col("capacity_tokens").cast("int").alias("capacity"), F.coalesce(F.col("separator_tokens"), F.lit(0)).cast("int").alias("separator")).filter("pack_name is not null and capacity > 0").dropDuplicates(["pack_name"])
    settings = [tuple(r) for r in packs.collect()]  # a settings table of a few rows
    items = sizes.select(F.col(id_col).alias("id"), F.coalesce(F.col("tokens"), F.lit(0)).cast("bigint").alias("tokens")).filter("id is not null")
    empty = T.StructType([T.StructField("pack_name", T.StringType()), T.StructField("container", T.StringType()), *sizes.select(id_col).schema.fields, T.StructField("piece", T.IntegerType()), T.StructField("start_token", T.LongType()), T.StructField("tokens", T.LongType())])
    if not settings:
        return sizes.sparkSession.createDataFrame([], empty)
    items = cut_lineage(items)
    shards = max(1, -(-items.count() // shard_items))
    pieces = F.explode(F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(c).alias("capacity"), F.lit(s).alias("separator")) for n, c, s in settings])).alias("p")
    dealt = items.select("id", "tokens", F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), pieces).select("p.*", "shard", "id", "tokens")
    columns = f"pack_name string, capacity int, separator int, shard bigint, container string, id {kind}, piece int, start_token bigint, tokens bigint, fill double"

    def first(group: pd.DataFrame) -> pd.DataFrame:
        capacity, separator = int(group["capacity"].iloc[0]), int(group["separator"].iloc[0])
        cut = [(i, p, start, length) for i, size in zip(group["id"].tolist(), group["tokens"].tolist(), strict=True) for p, (start, length) in enumerate(pieces_of(size, capacity))]
        return _laid(group, pd.DataFrame(cut, columns=["id", "piece", "start_token", "tokens"]), capacity, separator, f"{int(group['shard'].iloc[0])}")

    def again(group: pd.DataFrame) -> pd.DataFrame:
        return _laid(group, group[["id", "piece", "start_token", "tokens"]].reset_index(drop=True), int(group["capacity"].iloc[0]), int(group["separator"].iloc[0]), f"r{int(group['shard'].iloc[0])}")

    # a stated number of partitions, for AQE would merge these small but slow groups into few tasks
    spread_out = dealt.repartition(min(3 * len(settings) * shards, 8 * sizes.sparkSession.sparkContext.defaultParallelism), "pack_name", "shard")
    laid = cut_lineage(spread_out.groupBy("pack_name", "shard").applyInPandas(first, columns))
    good = laid.filter(F.col("fill") >= well_filled)
    rest = laid.filter(F.col("fill") < well_filled).withColumn("shard", F.floor(F.col("shard") / pool))
    repacked = rest.groupBy("pack_name", "shard").applyInPandas(again, columns)
    return good.unionByName(repacked).select("pack_name", "container", F.col("id").alias(id_col), "piece", "start_token", "tokens")


def _laid(group: pd.DataFrame, cut: pd.DataFrame, capacity: int, separator: int, prefix: str) -> pd.DataFrame:
    where = _pack(cut["id"].rank(method="dense").to_numpy(np.int64), cut["start_token"].to_numpy(np.int64), cut["tokens"].to_numpy(np.int64), capacity, separator)
    used = np.bincount(where, cut["tokens"].to_numpy(np.float64) + separator) - separator if len(where) else np.empty(0)
    return cut.assign(
        pack_name=group["pack_name"].iloc[0], capacity=capacity, separator=separator, shard=group["shard"].iloc[0],
        container=[f"{prefix}-{w}" for w in where], fill=used[where] / capacity,
    )[["pack_name", "capacity", "separator", "shard", "container", "id", "piece", "start_token", "tokens", "fill"]]
