"""The indexing plan: scan, diff, chunk, deduplicate, embed, commit."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.embed import Embedder, HashingEmbedder, embed
from quern.operators.store import embed_split
from quern.operators.syntax import chunk_syntax
from quern.runtime import cut_lineage, cut_table
from quern.sources.ignore import load_gitignore
from quern.sources.tree import list_tree, scan_tree
from quern.sources.versioned import VersionedTable, net_changes, process

KEYS = ["repo_root", "path"]


@dataclass
class IndexResult:
    change_type: str
    files_processed: int = 0
    files_deleted: int = 0
    chunks_created: int = 0
    cache_hits: int = 0
    chunks_embedded: int = 0
    chunks_skipped: int = 0
    seconds: float = 0.0


class Indexer:
    """Keeps the index of one tree: ``snapshot``, ``cache`` and ``locations`` below ``store``.

    ``snapshot`` holds the newest state of every file. ``locations`` processes its changes and
    saves the processed version in the commit that replaces the changed files' rows, so a run that
    fails before has at most added vectors to the content-addressed cache, and the next one
    processes the same files again.
    """

    def __init__(self, spark: SparkSession, root: str, store: str, embedder: Embedder | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.embedder = embedder or HashingEmbedder()
        self.locations, self.cache, self.snapshot = (VersionedTable(spark, f"{store}/{n}") for n in ("locations", "cache", "snapshot"))

    def _content(self, paths: list[str] | None = None) -> DataFrame:
        """The code files of the tree, or those of ``paths``, each read once."""
        return cut_table(scan_tree(self.spark, self.root, load_gitignore(self.root), code_only=True, with_content=True, paths=paths), "content")

    def _look(self, force: bool) -> DataFrame | None:
        """Commit the newest state of the tree; returns the content of the files that were read.

        Only files that are new or whose size or time of change (in milliseconds) differs are read,
        all of them with ``force`` and in the first run.
        """
        known = None if force else self.snapshot.read()
        if known is None:
            fresh = self._content()
            self.snapshot.replace(fresh.drop("content"), KEYS)
            return fresh
        listed = cut_lineage(list_tree(self.spark, self.root, load_gitignore(self.root), code_only=True))
        same = [*KEYS, "size", "mtime_ms"]
        # the listing is on the driver anyway, as the file index of the scan
        paths = [r["path"] for r in listed.join(known, same, "left_anti").select("path").collect()]
        fresh = self._content(paths) if paths else None
        state = listed.select(*same).join(known, same)
        self.snapshot.replace(state.select(*known.columns) if fresh is None else state.select(*known.columns).unionByName(fresh.drop("content")), KEYS)
        return fresh

    def index(self, force: bool = False) -> IndexResult:
        """Bring the index up to date; ``force`` indexes every file anew."""
        began = time.time()
        fresh = self._look(force)
        first = force or "processed:snapshot" not in self.locations.manifest()["meta"]
        result = IndexResult("none")

        def places(delta: DataFrame) -> DataFrame | None:
            changes = cut_lineage(net_changes(delta, KEYS, ["hash"]))
            counts = {r["change"]: r["n"] for r in changes.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
            result.files_processed, result.files_deleted = counts.get("added", 0) + counts.get("modified", 0), counts.get("deleted", 0)
            if first or counts:
                result.change_type = "full" if first else "incremental"
            # a file whose content is the same keeps its rows: the commit replaces them by themselves
            kept = delta.filter("_change = 'insert'").join(changes, KEYS, "left_anti").select(*KEYS)
            old = None if first else self.locations.read()
            kept = None if old is None else old.join(kept, KEYS, "left_semi")
            wanted = changes.filter("change <> 'deleted'").select(*KEYS)
            # a failed run may have committed states whose content it did not process
            missing = [r["path"] for r in (wanted if fresh is None else wanted.join(fresh.select(*KEYS), KEYS, "left_anti")).select("path").collect()]
            content = fresh
            if missing:
                content = self._content(missing) if fresh is None else fresh.unionByName(self._content(missing))
            if content is None or not result.files_processed:
                return kept
            new = self._places(content.join(wanted, KEYS, "left_semi"), int(began), result)
            return new if kept is None else kept.select(*new.columns).unionByName(new)

        process(self.snapshot, self.locations, places, "snapshot", KEYS, again=first)
        result.seconds = time.time() - began
        return result

    def _places(self, content: DataFrame, now: int, result: IndexResult) -> DataFrame:
        """The locations of the chunks of files, after vectors of new chunks were put into the cache."""
        chunks = cut_lineage(chunk_syntax(content))
        cached = self.cache.read()
        split = cut_lineage(embed_split(chunks, self.spark.createDataFrame([], "content_hash string") if cached is None else cached))
        missing = split.filter("action = 'embed'").select("content_hash", "content").dropDuplicates(["content_hash"])
        vectors = cut_lineage(embed(missing, self.embedder, "content_hash", "content"))
        result.chunks_embedded = vectors.count()
        if result.chunks_embedded:
            self.cache.append(vectors.withColumn("created_at", F.lit(now).cast("bigint")))
        by = {r["action"]: r["n"] for r in split.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}
        result.chunks_created, result.cache_hits, result.chunks_skipped = sum(by.values()), by.get("hit", 0), by.get("skipped", 0)
        return split.filter("action <> 'skipped'").select(*KEYS, "start_line", "end_line", "content_hash", "node_type", "node_name", "language").withColumn("created_at", F.lit(now).cast("bigint"))

    def stats(self) -> dict:
        """Totals of the index, and its locations by type and language."""
        places, cached = self.locations.read(), self.cache.read()
        if places is None or cached is None:
            return {"locations": 0, "hashes": 0, "files": 0, "vectors": 0}
        row = places.agg(F.count(F.lit(1)).alias("locations"), F.countDistinct("content_hash").alias("hashes"), F.countDistinct("path").alias("files")).first()
        group = lambda c: {r[0]: r[1] for r in places.groupBy(F.coalesce(c, F.lit("unknown"))).count().collect()}
        return row.asDict() | {"vectors": cached.count(), "by_node_type": group("node_type"), "by_language": group("language")}

    def orphans(self) -> DataFrame | None:
        """Cached hashes no location uses."""
        places, cached = self.locations.read(), self.cache.read()
        return None if cached is None or places is None else cached.join(places, "content_hash", "left_anti").select("content_hash").distinct()

    def search(self, text: str, limit: int = 10) -> DataFrame | None:
        """Places whose content is nearest to a text."""
        from quern.operators.knn import knn

        cached, places = self.cache.read(), self.locations.read()
        if cached is None or places is None:
            return None
        near = knn(cached, self.embedder.embed([text])[0].tolist(), "content_hash", "embedding", limit if limit > 0 else 10).filter("score > 0")
        return near.withColumnRenamed("id", "content_hash").join(places, "content_hash").select("path", "start_line", "end_line", "score", "node_name").orderBy(F.col("score").desc(), "path", "start_line")


def as_dict(result: IndexResult) -> dict:
    return asdict(result)
