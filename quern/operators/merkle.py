"""Content hashes of directory trees and their differences.

A tree is a table of files ``repo_root, path, hash, size``. The hash of a directory is the SHA-256 of
the hashes of its children in the order of their paths, built bottom up, one group-by per level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.runtime import cut_lineage, cut_table


def parent_of(path: Column) -> Column:
    """The directory of a path, empty for the top level."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def tree_nodes(files: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``repo_root, path, is_dir, depth, hash, size, files``: all files and directories of the trees.

    The loop runs once per level of the deepest path; each level groups its children and joins
    nothing. The hash of a directory is defined over the ordered hashes of its direct children, so
    one directory's children (path and hash only) meet in one group. Directory ``''`` is the root.
    """
    leaves = files.select("repo_root", "path", F.lit(False).alias("is_dir"), F.size(F.split("path", "/")).alias("depth"), "hash", F.col("size").cast("bigint").alias("size"), F.lit(1).cast("bigint").alias("files"))
    leaves = cut_table(leaves, "leaves", "depth")  # every level reads its own folder
    deepest = max_depth if max_depth is not None else leaves.agg(F.max("depth")).first()[0] or 0
    nodes, level = [leaves], None
    for depth in range(deepest, 0, -1):
        children = leaves.filter(F.col("depth") == depth)
        if level is not None:
            children = children.unionByName(level)
        level = children.groupBy("repo_root", parent_of(F.col("path")).alias("path")).agg(
            F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "hash"))), lambda x: x["hash"]), ""), 256).alias("hash"),
            F.sum("size").alias("size"),
            F.sum("files").alias("files"),
        ).select("repo_root", "path", F.lit(True).alias("is_dir"), F.lit(depth - 1).alias("depth"), "hash", "size", "files")
        level = cut_lineage(level)
        nodes.append(level)
    out = nodes[0]
    for n in nodes[1:]:
        out = out.unionByName(n)
    return out


def diff_trees(old: DataFrame, new: DataFrame) -> DataFrame:
    """``repo_root, path, is_dir, change`` of the nodes whose hash differs, or that one side lacks."""
    keys = ["repo_root", "path", "is_dir"]
    o, n = old.select(*keys, F.col("hash").alias("__o")), new.select(*keys, F.col("hash").alias("__n"))
    change = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "deleted").when(F.col("__o") != F.col("__n"), "modified")
    return o.join(n, keys, "full").select(*keys, change.alias("change")).filter("change is not null")


def changed_roots(old: DataFrame, new: DataFrame) -> DataFrame:
    """Repositories whose root hash differs: the early exit before a full diff."""
    top = (F.col("path") == "") & F.col("is_dir")
    return diff_trees(old.filter(top), new.filter(top)).select("repo_root")


def rollup(files: DataFrame) -> DataFrame:
    """``repo_root, dir, files, bytes``: recursive counts of every directory, by unrolling ancestors."""
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return files.select("repo_root", F.explode(ancestors).alias("dir"), "size").groupBy("repo_root", "dir").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
