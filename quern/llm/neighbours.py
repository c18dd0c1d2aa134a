"""The most similar vectors of every vector (problem 4).

Method: randomly rotated one-bit codes. Unit vectors of a space (a model and a number of
dimensions) are assigned to the nearest of its centroids; the residual is rotated by a random
orthogonal matrix and kept as one sign bit per dimension with three correction scalars (length of
the residual, its inner product with the centroid, and that of the rotated unit residual with its
code). For a query the packed bits give an estimate of every inner product together with an error
bound; only vectors whose upper bound reaches the k-th lower bound are compared exactly.

There is one centroid per ``list_size`` vectors. They are fitted in two levels on hash-chosen
samples: about the square root of their number as cells, then the lists of every cell, one task
each. Neighbouring lists of a cell form a bundle. A query looks into the lists that are at most
``1 + slack`` times as far as its nearest one, at least two and at most ``probes``, and travels once
to each bundle that holds any of them; its own bundle has it as a base vector with the same row.
Every vector is indexed and every vector is a query. Equal vectors are searched once and expanded
afterwards. Bundles are cut into blocks of base vectors and of queries, so one that holds a third of
all vectors becomes many bounded groups. Ids are numbers in the order of the hashes: only they
travel until the result is complete, and ties are told by them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.runtime import broadcast_if_small, cut_lineage


def usable_vectors(cache: DataFrame) -> DataFrame:
    """``model, dimensions, hash, embedding``: per hash the row with the smallest created_at, if its vector is sound.

    Sound: not null, of exactly ``dimensions`` values, none null, NaN or infinite, not all zero.
    Rows without hash or model are dropped; of rows created at the same time the first in the order
    of model and access counters counts; an unknown time is the latest.
    """
    order = F.struct(F.coalesce("created_at", F.lit(2**62)), F.coalesce("model", F.lit("")), F.coalesce("access_count", F.lit(0)), F.coalesce("last_accessed", F.lit(0)))
    first = cache.filter("content_hash is not null").groupBy("content_hash").agg(F.min_by(F.struct("model", "dimensions", "embedding"), order).alias("r"))
    rows = first.select(F.col("content_hash").alias("hash"), "r.*")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("embedding").isNotNull() & (F.size("embedding") == F.col("dimensions")) & ~bad & F.exists("embedding", lambda x: x != 0)
    return rows.filter(F.col("model").isNotNull() & F.coalesce(good, F.lit(False))).select("model", F.size("embedding").alias("dimensions"), "hash", "embedding")


def rotation(dimensions: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same for the same number of dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dimensions).normal(size=(dimensions, dimensions)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    scale = np.abs(v).max(1, keepdims=True)
    v = v / scale
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def encode(vectors: np.ndarray, centroids: np.ndarray, rotate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and (length, product with centroid, code alignment) of unit vectors."""
    residual = vectors - centroids
    length = np.linalg.norm(residual, axis=1)
    turned = residual @ rotate / np.maximum(length, 1e-12)[:, None]
    align = np.abs(turned).sum(1) / np.sqrt(vectors.shape[1])
    scalars = np.stack([length, (residual * centroids).sum(1), np.maximum(align, 1e-6)], 1).astype(np.float32)
    return np.packbits(turned > 0, axis=1), scalars


def candidates(codes: np.ndarray, scalars: np.ndarray, queries: np.ndarray, centroid: np.ndarray, rotate: np.ndarray, k: int, least: np.ndarray, epsilon: float = 1.9) -> np.ndarray:
    """Which coded vectors (columns) every query (rows) has to be compared with exactly: those whose
    upper bound reaches the k-th lower bound, and ``least`` of the query."""
    dims = queries.shape[1]
    signs = (np.unpackbits(codes, axis=1, count=dims).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dims))
    length, product, align = scalars.T
    slack = length * np.sqrt(np.maximum(1 - align**2, 0)) / align * np.float32(epsilon / np.sqrt(max(1, dims - 1)))
    rest = queries - centroid
    estimate = (rest @ rotate) @ (signs * (length / align)[:, None]).T
    estimate += (queries @ centroid)[:, None] + product[None, :]
    bound = np.linalg.norm(rest, axis=1)[:, None] * slack[None, :]
    threshold = least
    if len(codes) > k:
        low = estimate - bound
        threshold = np.maximum(least, np.partition(low, len(codes) - k, axis=1)[:, len(codes) - k])
    return estimate + bound >= threshold[:, None]


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Spherical k-means on a bounded sample of unit vectors."""
    r = np.random.default_rng(seed)
    centroids = sample[r.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        home = nearest(sample, centroids, 1)[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, sample)
        norm = np.linalg.norm(sums, axis=1)
        empty = norm < 1e-9
        centroids = sums / np.maximum(norm, 1e-9)[:, None]
        if empty.any():
            centroids[empty] = sample[r.choice(len(sample), int(empty.sum()))]
    return centroids.astype(np.float32)


def nearest(vectors: np.ndarray, centroids: np.ndarray, probes: int, step: int = 4096) -> np.ndarray:
    """The ``probes`` nearest centroids of each vector, nearest first."""
    out = []
    for start in range(0, len(vectors), step):
        score = vectors[start : start + step] @ centroids.T
        top = np.argpartition(-score, min(probes, score.shape[1]) - 1, axis=1)[:, :probes]
        out.append(np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.empty((0, probes), np.int64)


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """Lists of the same length as rows of a matrix."""
    return np.asarray(column.flatten(), np.float32).reshape(-1, dimensions)


def _binary(rows: np.ndarray) -> pa.Array:
    """Every row of a matrix as one binary value."""
    rows = np.ascontiguousarray(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """Binary values of the same length as rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1)


class Space(NamedTuple):
    """The centroids of a model and number of dimensions, and the bundle of each."""

    centroids: np.ndarray
    bundles: np.ndarray


def _by_space(batch: pa.RecordBatch, spaces: dict[tuple[str, int], int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(space, rows, their vectors) of a batch with ``model, dimensions, embedding``."""
    own = np.array([spaces.get(s, -1) for s in zip(batch["model"].to_pylist(), batch["dimensions"].to_pylist(), strict=True)])
    for number in np.unique(own[own >= 0]):
        at = np.flatnonzero(own == number)
        yield int(number), at, _matrix(batch["embedding"].take(pa.array(at)), batch["dimensions"][int(at[0])].as_py())


def _share(n: int, rows: int) -> int:
    """The part of ``n`` rows, in millionths, that gives about ``rows`` of them."""
    return 1_000_000 if n <= rows else ceil(1_000_000 * rows / n)


def _fit(reps: DataFrame, spaces: dict[tuple[str, int], int], counts: list[int], list_size: int, bundle: int, sample: int, per_list: int) -> list[Space]:
    """Centroids and bundles of all spaces, fitted in two levels by the executors."""
    picked = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1_000_000))
    key = F.concat_ws("/", "dimensions", "model")
    name = {number: f"{dims}/{model}" for (model, dims), number in spaces.items()}
    share = lambda rows: F.create_map(*[F.lit(x) for n, c in enumerate(counts) for x in (name[n], _share(c, rows(c)))])[key]
    cells = [max(1, round(sqrt(max(1, round(c / list_size))))) for c in counts]

    def fit_cells(group: pa.Table) -> pa.Table:
        number = spaces[group["model"][0].as_py(), group["dimensions"][0].as_py()]
        some = unit(_matrix(group.sort_by("id")["embedding"].combine_chunks(), group["dimensions"][0].as_py()))
        return pa.table({"space": pa.array([number] * min(cells[number], len(some)), pa.int32()), "centroid": _binary(fit_centroids(some, cells[number]))})

    columns = reps.select("model", "dimensions", "id", "embedding")
    fitted = columns.filter(picked < share(lambda c: sample)).groupBy("model", "dimensions").applyInArrow(fit_cells, "space int, centroid binary").toArrow()
    number = np.asarray(fitted["space"])
    tops = [_vectors(fitted["centroid"].filter(pa.array(number == n))) for n in range(len(counts))]  # square root of the lists
    sent = reps.sparkSession.sparkContext.broadcast(tops)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, at, raw in _by_space(batch, spaces):
                v = unit(raw)
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(at), pa.int32()), pa.array(nearest(v, sent.value[n], 1)[:, 0].astype(np.int32)), batch["id"].take(pa.array(at)), _binary(v)], names=["space", "cell", "id", "vec"])

    # enough for every list, at least 4 096 of a space
    wanted = lambda c: max(4_096, ceil(c * per_list / list_size))
    placed = cut_lineage(columns.filter(picked < share(wanted)).mapInArrow(place, "space int, cell int, id bigint, vec binary"))
    held = placed.groupBy("space", "cell").agg(F.count(F.lit(1)).alias("held"))
    grown = F.create_map(*[F.lit(x) for n, c in enumerate(counts) for x in (n, min(1.0, wanted(c) / c))])[F.col("space")]
    lists = F.greatest(F.lit(1), F.round(F.col("held") / grown / list_size)).cast("int").alias("lists")
    # one row per cell
    bounded = placed.join(F.broadcast(held), ["space", "cell"]).filter(F.pmod(F.xxhash64("id", F.lit(18)), F.lit(1_000_000)) < F.lit(1e6 * sample) / F.col("held")).select("space", "cell", "id", "vec", lists)

    def fit_lists(group: pa.Table) -> pa.Table:
        some = _vectors(group.sort_by("id")["vec"])
        own = fit_centroids(some, min(group["lists"][0].as_py(), max(1, len(some) // 4)))
        heads = fit_centroids(own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9), ceil(len(own) / bundle))
        space, cell = (pa.array([group[c][0].as_py()] * len(own), pa.int32()) for c in ("space", "cell"))
        return pa.table({"space": space, "cell": cell, "bundle": pa.array(nearest(own, heads, 1)[:, 0].astype(np.int32)), "centroid": _binary(own)})

    rows = bounded.groupBy("space", "cell").applyInArrow(fit_lists, "space int, cell int, bundle int, centroid binary").toArrow()  # one centroid per list
    number, out = np.asarray(rows["space"]), []
    for n in range(len(counts)):
        own = rows.filter(pa.array(number == n))
        pairs = np.stack([np.asarray(own["cell"]), np.asarray(own["bundle"])], 1)
        out.append(Space(_vectors(own["centroid"]), np.unique(pairs, axis=0, return_inverse=True)[1].astype(np.int32).reshape(-1)))
    return out


def _routes(v: np.ndarray, space: Space, probes: int, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(own list of every vector; row, list, bundle of the lists each looks into, ordered by row and bundle)."""
    near = nearest(v, space.centroids, min(probes, len(space.centroids)))
    far = np.sqrt(np.maximum(1 + (space.centroids**2).sum(1)[near] - 2 * _products(v, space.centroids, near), 0))
    use = far <= far[:, :1] * (1 + slack)
    use[:, :2] = True
    row, column = np.nonzero(use)
    lists = near[row, column]
    bundles = space.bundles[lists]
    order = np.lexsort((column, bundles, row))
    return near[:, 0], row[order], lists[order], bundles[order]


def _products(v: np.ndarray, centroids: np.ndarray, near: np.ndarray, step: int = 1024) -> np.ndarray:
    """Inner products of vectors with the centroids ``near`` them."""
    return np.concatenate([np.einsum("nd,npd->np", v[n : n + step], centroids[near[n : n + step]]) for n in range(0, max(1, len(v)), step)])


def _first(query: np.ndarray, near: np.ndarray, cosine: np.ndarray, k: int) -> np.ndarray:
    """Rows of the ``k`` largest cosines of every query, ordered by query; ties go to the smaller id."""
    order = np.lexsort((near, -cosine, query))
    ordered = query[order]
    start = np.flatnonzero(np.diff(ordered, prepend=-1)) if len(ordered) else np.empty(0, np.int64)
    rank = np.arange(len(ordered)) - np.repeat(start, np.diff(start, append=len(ordered)))
    return order[rank < k]


def _chosen_products(queries: np.ndarray, base: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Inner products of the chosen pairs, -2 for the others; many are cheapest as one matrix product."""
    if np.count_nonzero(chosen) * 20 > chosen.size:
        return np.where(chosen, queries @ base.T, np.float32(-2))
    out = np.full(chosen.shape, -2, np.float32)
    i, j = np.nonzero(chosen)
    out[i, j] = np.einsum("nd,nd->n", queries[i], base[j])
    return out


def search_bundle(ids: np.ndarray, raw: np.ndarray, home: np.ndarray, base: np.ndarray, asks: tuple[np.ndarray, np.ndarray], centroids: np.ndarray, k: int, cells: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, near row, cosine) of the ``k`` nearest base vectors of every query in its lists.

    ``home`` is the list of every row, ``base`` marks base vectors, ``asks`` are (row, list) of the
    queries, ``centroids`` those of all lists. Rows in their own list are searched first, so their
    k-th cosine holds for their other lists.
    """
    v = unit(raw)
    rotate = rotation(raw.shape[1])
    least = np.full(len(ids), -2, np.float32)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    coded = {}
    for number in np.unique(home[base]):
        rows = np.flatnonzero(base & (home == number))
        coded[number] = (rows, *encode(v[rows], centroids[number], rotate))
    own = home[asks[0]] == asks[1]
    for part in (own, ~own):
        row, number = asks[0][part], asks[1][part]
        order = np.argsort(number, kind="stable")
        row, number = row[order], number[order]
        start = np.flatnonzero(np.diff(number, prepend=-1))
        for at, stop in zip(start, np.append(start[1:], len(number)), strict=False):
            if number[at] not in coded:
                continue
            rows, codes, scalars = coded[number[at]]
            step = max(1, cells // len(rows))
            for n in range(at, stop, step):
                q = row[n : min(n + step, stop)]
                chosen = candidates(codes, scalars, v[q], centroids[number[at]], rotate, k + 1, least[q])
                chosen &= ids[q][:, None] != ids[rows][None, :]
                cosine = _chosen_products(v[q], v[rows], chosen)
                if len(rows) >= k:
                    last = np.partition(cosine, len(rows) - k, axis=1)[:, len(rows) - k]
                    least[q] = np.maximum(least[q], last - np.float32(2e-6))  # what single precision may hide
                i, j = np.nonzero(chosen & (cosine >= least[q][:, None]))
                kept.append((q[i], rows[j]))
    if not kept:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0)
    query, near = (np.concatenate(c) for c in zip(*kept, strict=True))
    single = np.concatenate([np.einsum("nd,nd->n", v[query[m : m + cells]], v[near[m : m + cells]]) for m in range(0, max(1, len(query)), cells)])
    good = single >= least[query] - np.float32(1e-6)
    query, near = query[good], near[good]
    exact = raw.astype(np.float64)
    norms = np.linalg.norm(exact, axis=1)
    step = 1 << 17
    cosine = np.concatenate([np.einsum("nd,nd->n", exact[query[m : m + step]], exact[near[m : m + step]]) for m in range(0, max(1, len(query)), step)])
    cosine = np.minimum(np.round(cosine / (norms[query] * norms[near]), 12), 1.0)
    first = _first(query, ids[near], cosine, k)
    return query[first], near[first], cosine[first]


def _packed(query_ids: np.ndarray, near_ids: np.ndarray, cosine: np.ndarray) -> pa.Table:
    """One row per query: its neighbours and cosines as bytes. Rows must be ordered by query."""
    start = np.flatnonzero(np.diff(query_ids, prepend=-1)) if len(query_ids) else np.empty(0, np.int64)
    stops = np.append(start[1:], len(query_ids)) if len(start) else start
    blobs = [near_ids[a:b].tobytes() + cosine[a:b].tobytes() for a, b in zip(start, stops, strict=True)]
    return pa.table({"id": pa.array(query_ids[start], pa.int64()), "near": pa.array(blobs, pa.binary())})


def _numbered(cache: DataFrame) -> DataFrame:
    """The usable vectors with ``id``, a number in the order of their hashes."""
    ranged = usable_vectors(cache).repartitionByRange("hash").sortWithinPartitions("hash")
    return cut_lineage(ranged.withColumn("id", F.monotonically_increasing_id()))


def nearest_ids(
    vectors: DataFrame,
    k: int = 10,
    probes: int = 32,
    slack: float = 0.35,
    list_size: int = 500,
    bundle: int = 16,
    sample: int = 16_384,
    per_list: int = 64,
    block: int = 16_384,
) -> DataFrame:
    """``id, other, cosine``: the ``k`` most similar vectors of every one of ``vectors`` (``model,
    dimensions, id, embedding``), by number.

    The samples the centroids are fitted on are about ``sample`` vectors of a space for its cells,
    and ``per_list`` for every list, but at most about ``sample`` of one cell.
    """
    spark = vectors.sparkSession
    schema = "id bigint, other bigint, cosine double"
    # equal vectors are told by two hashes of 96 bits together; only numbers move
    narrow = vectors.select("model", "dimensions", F.xxhash64("embedding").alias("x"), F.hash("embedding").alias("y"), "id")
    same = ["model", "dimensions", "x", "y"]
    ranked = narrow.withColumn("__n", F.row_number().over(W.partitionBy(*same).orderBy("id"))).filter(F.col("__n") <= k + 1)
    groups = ranked.groupBy(*same).agg(F.sort_array(F.collect_list("id")).alias("members")).filter(F.size("members") > 1)
    groups = cut_lineage(groups.withColumn("rep", F.col("members")[0]))
    copies = cut_lineage(narrow.join(groups, same).filter(F.col("id") != F.col("rep")).select("id", "rep", "members"))
    reps = vectors.join(broadcast_if_small(copies.select("id"), 1_000_000), "id", "left_anti")
    held = reps.groupBy("model", "dimensions").agg(F.count(F.lit(1)).alias("n")).orderBy("model", "dimensions").collect()  # one row per space
    if not held:
        return spark.createDataFrame([], schema)
    spaces = {(r["model"], r["dimensions"]): n for n, r in enumerate(held)}
    sent = spark.sparkContext.broadcast(_fit(reps, spaces, [r["n"] for r in held], list_size, bundle, sample, per_list))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch["id"])
            for number, at, raw in _by_space(batch, spaces):
                space = sent.value[number]
                v = unit(raw)
                own, row, lists, bundles = _routes(v, space, probes, slack)
                start = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(bundles, prepend=-1) != 0))
                row_of, bundle_of = row[start], bundles[start]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number] * len(start), pa.int32()),
                        pa.array(bundle_of, pa.int32()),
                        pa.array(ids[at][row_of]),
                        pa.array(np.where(space.bundles[own[row_of]] == bundle_of, own[row_of], -1).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(np.append(start, len(row)).astype(np.int32)), pa.array(lists.astype(np.int32))),
                        _binary(raw[row_of]),
                    ],
                    names=["space", "bundle", "id", "home", "lists", "vec"],
                )

    routed = cut_lineage(reps.select("model", "dimensions", "id", "embedding").mapInArrow(route, "space int, bundle int, id bigint, home int, lists array<int>, vec binary"))
    parts = lambda c: F.greatest(F.ceil(c / block), F.lit(1)).cast("int")
    # one row per bundle, of which there are fewer than centroids
    plan = F.broadcast(routed.groupBy("space", "bundle").agg(parts(F.sum((F.col("home") >= 0).cast("int"))).alias("bases"), parts(F.count(F.lit(1))).alias("askers")))
    salt = lambda c, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(c)).cast("int")
    cell = lambda b, a, base, ask: F.struct(b.alias("b"), a.alias("a"), F.lit(base).alias("base") if isinstance(base, bool) else base.alias("base"), F.lit(ask).alias("ask"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    asking = F.transform(upto("bases"), lambda b: cell(b, F.col("own_a"), (F.col("home") >= 0) & (b == F.col("own_b")), True))
    lying = F.when(F.col("home") >= 0, F.filter(F.transform(upto("askers"), lambda a: cell(F.col("own_b"), a, True, False)), lambda x: x["a"] != F.col("own_a"))).otherwise(F.array().cast("array<struct<b:int,a:int,base:boolean,ask:boolean>>"))
    spread_out = routed.join(plan, ["space", "bundle"]).withColumn("own_b", salt("bases", 1)).withColumn("own_a", salt("askers", 2)).withColumn("at", F.explode(F.concat(asking, lying))).select("space", "bundle", "at.*", "id", "home", "lists", "vec")

    def compare(group: pa.Table) -> pa.Table:
        space = sent.value[group["space"][0].as_py()]
        ids, home, base, ask = (np.asarray(group[c]) for c in ("id", "home", "base", "ask"))
        lists = group["lists"].combine_chunks()
        asks = np.repeat(np.arange(len(ids)), np.asarray(lists.value_lengths())), np.asarray(lists.flatten())
        wanted = ask[asks[0]]
        query, near, cosine = search_bundle(ids, _vectors(group["vec"]), home, base, (asks[0][wanted], asks[1][wanted]), space.centroids, k)
        return _packed(ids[query], ids[near], cosine)

    compared = spread_out.groupBy("space", "bundle", "b", "a").applyInArrow(compare, "id bigint, near binary")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            blobs = [x for own in batch["near"].to_pylist() for x in own]
            counts = [sum(len(x) // 16 for x in own) for own in batch["near"].to_pylist()]
            query = np.repeat(np.asarray(batch["id"]), counts)
            near = np.concatenate([np.frombuffer(x, np.int64, len(x) // 16) for x in blobs])
            cosine = np.concatenate([np.frombuffer(x, np.float64, len(x) // 16, len(x) // 2) for x in blobs])
            first = _first(query, near, cosine, k)
            yield pa.RecordBatch.from_arrays([pa.array(query[first]), pa.array(near[first]), pa.array(cosine[first])], names=["id", "near", "cosine"])

    # at most k entries of every bundle and block a query looked into
    found = compared.groupBy("id").agg(F.collect_list("near").alias("near")).mapInArrow(best, "id bigint, near bigint, cosine double")
    several = groups.select("rep", "members")
    others = found.join(several.withColumnRenamed("rep", "near"), "near", "left").select("id", F.explode(F.coalesce("members", F.array("near"))).alias("other"), "cosine")
    own = several.select(F.col("rep").alias("id"), F.explode("members").alias("other"), F.lit(1.0).alias("cosine"))
    # at most (k + 1) squared entries
    top = others.unionByName(own).groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("c"), F.col("other").alias("o")))), 1, k + 1).alias("top"))
    listed = top.join(several.withColumnRenamed("rep", "id"), "id", "left").select(F.explode(F.coalesce("members", F.array("id"))).alias("id"), "top")
    pairs = listed.select("id", F.explode(F.slice(F.filter("top", lambda x: x["o"] != F.col("id")), 1, k)).alias("x")).select("id", F.col("x.o").alias("other"), (-F.col("x.c")).alias("cosine"))
    # copies beyond the first k + 1 of a vector have the first k as neighbours
    late = copies.filter((F.size("members") > k) & (F.col("id") > F.col("members")[k])).select("id", F.explode(F.slice("members", 1, k)).alias("other"), F.lit(1.0).alias("cosine"))
    return pairs.unionByName(late)


def nearest_vectors(cache: DataFrame, k: int = 10, **options) -> DataFrame:
    """``model, hash, neighbour, similarity``: the ``k`` most similar hashes of every usable hash.

    Similarity is the exact cosine of the stored values; ties within 1e-12 go to the smaller hash.
    Vectors of different models or numbers of dimensions are never compared. Which vectors of a
    space are compared is decided by its lists and by the error bounds of the codes (``options`` are
    those of ``nearest_ids``). Spaces of one vector, and empty tables, give no rows; copies of a
    vector are each other's neighbours with similarity 1. Extra columns are ignored.
    """
    vectors = _numbered(cache)
    found = nearest_ids(vectors, k, **options)
    names = vectors.select("id", "model", "hash")
    told = found.join(names.select(F.col("id").alias("other"), F.col("hash").alias("neighbour")), "other")
    return told.join(names, "id").select("model", "hash", "neighbour", F.col("cosine").alias("similarity"))


def nearest_pairs(cache: DataFrame, k: int = 10, **options) -> DataFrame:
    """``neighbour_pairs(nearest_vectors(...))``, made distinct before the hashes are looked up."""
    vectors = _numbered(cache)
    found = nearest_ids(vectors, k, **options)
    pairs = found.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    hashes = lambda c: vectors.select(F.col("id").alias(c), F.col("hash").alias(f"hash_{c}"))
    return pairs.join(hashes("a"), "a").join(hashes("b"), "b").select("hash_a", "hash_b")


def neighbour_pairs(neighbours: DataFrame) -> DataFrame:
    """``hash_a, hash_b`` (smaller first): pairs of which one is among the neighbours of the other."""
    return neighbours.select(F.least("hash", "neighbour").alias("hash_a"), F.greatest("hash", "neighbour").alias("hash_b")).distinct()
