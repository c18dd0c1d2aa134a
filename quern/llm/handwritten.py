"""Generated, minified, vendored and data files among source files (problem 7).

Method: an inverted index of rare line hashes gives the exact containment of every file in every
known library, across repositories, so patched and renamed copies are found wherever they lie;
rules on the composition of tokens decide about the remaining files: machine-written lines repeat
one skeleton with other numbers, bundles have long lines almost without blanks, data consists of
literals.

Contents are looked at once per distinct chunk; only counts and line hashes leave that map. A chunk
that lies in very many repositories is one row there, and its locations are the large side of a
join that AQE splits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.identity import canonical_hash
from quern.runtime import broadcast_if_small, cut_lineage, spread

#: Extensions and names of configuration and prose, which are never cases.
NOT_CODE = ("md", "markdown", "rst", "txt", "adoc", "env", "yml", "yaml", "properties", "json", "toml", "xml", "ini", "cfg", "conf", "csv", "lock", "gitignore", "dockerignore", "editorconfig")
_GENERATED = re.compile(
    r"(?im)^[^\w\n]{0,8}(?:code generated by\b|@generated\b|<auto-?generated>|auto-?generated (?:file|code|by|from)\b|(?:this|the) (?:file|code|class) (?:was|is|has been) (?:automatically|auto)[ -]*(?:generated|produced|created|written)\b|(?:generated|produced) (?:automatically )?(?:by|from) [\w.\-/]+[^\n]{0,60}do not (?:edit|modify)|automatisch (?:erzeugt|generiert)\b|généré automatiquement|fichier généré|generado automáticamente|archivo generado)"
)
_LIBRARY = re.compile(r"^\W{0,6}([A-Za-z][\w.\-]*)\s+v?(\d+\.\d+\.\d+)\b[^|\n]*$")
#: A banner below the first line: nothing but a mark, a licence or an address follows the version.
_LATER = re.compile(r"^\W{0,6}([A-Za-z][\w.\-]*)\s+v?(\d+\.\d+\.\d+)(?:[\-+][\w.\-]+)?(?:\s*[^\w\s|][^|]*|\s+(?i:by|copyright|released|licen[sc]ed?|https?|under|build|built)\b[^|]*)?\s*$")
#: Words before a version that name no library.
_NO_NAME = set("version ver since release released revision rev license licence licenses apache mit gpl lgpl agpl mpl bsd copyright python node nodejs go golang java jdk php ruby rust cargo npm requires require required compatible from by of the for with protocol api schema updated deprecated introduced added changed removed fixed todo see until before after in at to and or on".split())
_COMMENT = re.compile(r"#(?!\s*(?:include|define|undef|if|ifdef|ifndef|pragma|import|region|using)\b|\[)|//|\*|--|;|%|<\?(?:php|xml)|<!DOCTYPE|[\"']use strict")
_BLOCKS = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''", "{-": "-}", "(*": "*)", "--[[": "]]", "=begin": "=end"}
_NUMBER = re.compile(r"0x[0-9a-fA-F]+|\d+(?:\.\d+)?")
#: A name or hexadecimal constant with a number in it, after numbers became 0: programs number names, people number arguments.
_NUMBERED = re.compile(r"[A-Za-z_]0")
_ASSERTION = re.compile(r"(?i)(?:\w+\.)*(?:assert|expect|check|require|test|it|should|must)\w*\b")
_DATA = re.compile(r"""(?:(?=\D*\d)[\s\-+\d.,;:(){}\[\]'"xXa-fA-F]*|["']?[A-Za-z0-9+/=_\\]{24,}["']?[,;+\\]?|(?i:insert into)\b.*|\(.*\)[,;])$""")

#: Lines shorter than this say too little to tell where they come from.
LINE_LEAST = 16

#: Lines in more libraries than this belong to none of them.
SHARED_MOST = 8

_FEATURES = "hash binary, lines int, chars bigint, blanks bigint, skeleton int, data int, generated boolean, library string, comment boolean, rare array<bigint>"


def _leading(lines: list[str]) -> tuple[list[str], bool]:
    """The comment lines before the first line of code, and whether there is no code at all."""
    close = ""
    for n, line in enumerate(lines):
        if not close:
            opening = next((o for o in _BLOCKS if line.startswith(o)), "")
            if not opening:
                if not _COMMENT.match(line):
                    return lines[:n], False
                continue
            close, line = _BLOCKS[opening], line[len(opening) :]
        if close in line:
            rest, close = line.split(close, 1)[1].strip(), ""
            if rest and not _COMMENT.match(rest):
                return lines[: n + 1], False
    return lines, True


def composition(text: str, first: bool) -> tuple[int, int, int, int, int, bool, str | None, bool, list[int]]:
    """(lines, characters, blanks, lines of a repeated skeleton, data lines, banner, library, only comments, line hashes)."""
    lines = [s for x in text.split("\n") if (s := x.strip())]
    leading, comment = _leading(lines)
    head = "\n".join(lines[: max(6, len(leading))] if first else leading)
    match = _LIBRARY.match(lines[0]) if first and lines else None
    match = match or next((m for x in leading if (m := _LATER.match(x)) and m[1].lower() not in _NO_NAME), None)
    count = Counter(_NUMBER.sub("0", "\n".join(lines)).split("\n"))
    skeleton = sum(n for s, n in count.items() if n >= 4 and len(s) > 6 and _NUMBERED.search(s) and not _ASSERTION.match(s))
    data = sum(_DATA.match(x) is not None for x in lines)
    hashes = {xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in lines if len(x) >= LINE_LEAST}
    blanks = len(text) - len("".join(text.split()))
    return len(lines), len(text), blanks, skeleton, data, bool(_GENERATED.search(head)), match[1].lower() if match else None, comment, sorted(hashes)


def _extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))


def _key(*columns: Column) -> Column:
    """16 bytes for a combination of texts; null if any is null."""
    return F.unhex(F.md5(F.concat(*[x for c in columns for x in (c, F.lit("\0"))])))


def chunk_features(chunks: DataFrame) -> DataFrame:
    """One row of counts and line hashes for every distinct content of a code file."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(h, *composition(t, s <= 3)) for h, t, s in zip(batch["hash"], batch["content"], batch["start_line"], strict=True)]
            yield pd.DataFrame(rows, columns=["hash", "lines", "chars", "blanks", "skeleton", "data", "generated", "library", "comment", "rare"])

    code = chunks.filter(~_extension(F.col("path")).isin(*NOT_CODE)).select(_key(canonical_hash(F.col("content_hash"))).alias("hash"), "content", F.coalesce("start_line", F.lit(1)).alias("start_line"))
    seen = spread(code.filter("hash is not null and content is not null")).mapInPandas(look, _FEATURES)
    kept = [c.split()[0] for c in _FEATURES.split(", ")[1:]]
    one = F.max_by(F.struct(*kept), F.struct(F.col("generated"), F.col("library").isNotNull(), F.col("lines"))).alias("f")
    return seen.groupBy("hash").agg(one).select("hash", "f.*")


def _companions(files: DataFrame, named: DataFrame) -> DataFrame:
    """``n, of``: contents of files without a banner that come with a library.

    They lie in the folder of its bannered file in at least two repositories, in more than half of
    the repositories that hold them and in a quarter of those that hold the library; code that the
    repositories' people copied, and that lies beside a library here and there, does not.
    """
    homes = files.join(named, "file").select("repo", "folder", "of").distinct()
    spread_of = homes.groupBy("of").agg(F.countDistinct("repo").alias("homes")).filter("homes > 1")
    bare = files.filter(F.col("total") >= 3).join(named, "file", "left_anti").select("repo", "folder", "n").distinct()
    beside = bare.join(homes.join(spread_of, "of"), ["repo", "folder"]).groupBy("n", "of").agg(F.countDistinct("repo").alias("beside"), F.max("homes").alias("homes")).filter("beside > 1 and 4 * beside >= homes")
    held = files.select("n", "repo").join(beside.select("n").distinct(), "n").groupBy("n").agg(F.countDistinct("repo").alias("held"))
    return beside.join(held, "n").filter("2 * beside > held").select("n", "of")


def _known_lines(lines: DataFrame, contained: float) -> DataFrame:
    """``line, names``: the libraries every line of ``lines`` (``of, line``) tells of.

    A line in several libraries tells of all of them if one of them holds, or is held by, each of the
    others (the same library under two names, or one that bundles others); else it is common, and
    its names are empty.
    """
    lines = cut_lineage(lines)
    several = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.min("of").alias("of"))
    shared = lines.join(several.filter(F.col("n").between(2, SHARED_MOST)).select("line", "n"), "line")
    pairs = shared.join(shared.select("line", F.col("of").alias("other")), "line").filter("of <> other")
    sizes = lines.groupBy("of").agg(F.count(F.lit(1)).alias("size"))
    kin = (
        pairs.groupBy("of", "other").agg(F.count(F.lit(1)).alias("both"))
        .join(sizes, "of").join(sizes.select(F.col("of").alias("other"), F.col("size").alias("other_size")), "other")
        .filter(F.col("both") >= contained * F.least("size", "other_size")).select("of", "other")
    )
    hubs = pairs.join(kin, ["of", "other"]).groupBy("line", "of").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n")).filter("k = n - 1").select("line").distinct()
    names = shared.join(hubs, "line").groupBy("line").agg(F.collect_set("of").alias("names"))
    none = F.array().cast("array<string>")
    return several.join(names, "line", "left").select("line", F.when(F.col("n") == 1, F.array("of")).otherwise(F.coalesce("names", none)).alias("names"))


def not_handwritten(locations: DataFrame, chunks: DataFrame, contained: float = 0.5, repeated: float = 0.5, literal: float = 0.5, long_line: int = 150) -> DataFrame:
    """``repo_root, path, reason``: every file of ``locations`` that nobody of the repository wrote
    by hand (``vendored``, ``generated``, ``minified`` or ``data``).

    A file is the set of contents its locations (and chunks of the same path) name, whatever the
    spelling of the hashes; files of which no content is known, rows with null or empty
    repo_root, path or hash, and configuration and prose are no cases. Rows written again count
    once. Empty tables give no rows; extra columns are ignored.
    """
    # contents get numbers, files and folders keys of a few bytes: names come back at the end
    features = cut_lineage(chunk_features(chunks).withColumn("n", F.monotonically_increasing_id()))
    named_rows = lambda df: df.filter("repo_root <> '' and path <> ''")
    file = _key(F.col("repo_root"), F.col("path")).alias("file")
    folder = F.xxhash64("repo_root", F.regexp_extract("path", r"^(.*?)[^/\\\\]*$", 1)).alias("folder")
    keyed = lambda df: named_rows(df).select(file, F.xxhash64("repo_root").alias("repo"), folder, F.coalesce("start_line", F.lit(1)).alias("start"), _key(canonical_hash(F.col("content_hash"))).alias("hash")).filter("hash is not null")
    places = keyed(locations.filter(~_extension(F.col("path")).isin(*NOT_CODE)))
    listed = named_rows(locations).select(file).distinct()
    own = keyed(chunks).join(listed, "file", "left_semi")
    parts = places.unionByName(own).groupBy("file", "hash").agg(F.min("start").alias("start"), F.first("repo").alias("repo"), F.first("folder").alias("folder"))
    counts = features.select("hash", "n", "lines", "chars", "blanks", "skeleton", "data", "generated", "library", "comment", F.size("rare").alias("total"))
    placed = cut_lineage(parts.join(counts, "hash").drop("hash"))
    # banners count up to the part in which the first code of the file lies
    late = placed.filter((F.col("generated") | F.col("library").isNotNull()) & (F.col("start") > 3)).select("file", "n", "start")
    code = placed.join(broadcast_if_small(late.select("file").distinct()), "file", "left_semi").groupBy("file").agg(F.min(F.when(~F.col("comment"), F.col("start"))).alias("code"))
    void = cut_lineage(late.join(code, "file").filter("start > code").select("file", "n", F.lit(True).alias("void")))
    files = placed.join(broadcast_if_small(void), ["file", "n"], "left")
    files = files.withColumn("generated", F.col("generated") & F.col("void").isNull()).withColumn("library", F.when(F.col("void").isNull(), F.col("library"))).drop("void", "start", "comment")
    # libraries: the contents of files that carry a library's banner, and of files that come with them
    named = cut_lineage(files.filter("library is not null").groupBy("file").agg(F.min("library").alias("of")))
    members = files.select("file", "n").join(named, "file").select("n", "of").unionByName(_companions(files, named)).distinct()
    known = _known_lines(members.join(features.select("n", "rare"), "n").select("of", F.explode("rare").alias("line")).distinct(), contained)
    # hits by library; those of no library are lines that say nothing
    hits = features.select("n", F.explode("rare").alias("line")).join(known, "line").select("n", F.explode_outer("names").alias("of")).groupBy("n", "of").agg(F.count(F.lit(1)).alias("hits"))
    total = files.groupBy("file").agg(
        *[F.sum(c).alias(c) for c in ("lines", "chars", "blanks", "skeleton", "data", "total")],
        F.max("generated").alias("generated"),
        F.max(F.col("library").isNotNull()).alias("banner"),
    )
    best = (
        files.select("file", "n").join(hits, "n").groupBy("file", "of").agg(F.sum("hits").alias("hits"))
        .groupBy("file").agg(F.max(F.when(F.col("of").isNotNull(), F.col("hits"))).alias("hits"), F.max(F.when(F.col("of").isNull(), F.col("hits"))).alias("common"))
    )
    telling = F.col("total") - F.coalesce("common", F.lit(0))
    reason = (
        F.when(F.col("banner") | ((telling >= 3) & (F.col("hits") >= contained * telling)), "vendored")
        .when(F.col("generated") | ((F.col("lines") >= 5) & (F.col("skeleton") >= repeated * F.col("lines")) & (F.col("data") < literal * F.col("lines"))), "generated")
        .when((F.col("chars") >= long_line * F.col("lines")) & (F.col("blanks") < 0.1 * F.col("chars")), "minified")
        .when((F.col("lines") >= 5) & (F.col("data") >= literal * F.col("lines")), "data")
    )
    told = total.join(best, "file", "left").withColumn("hits", F.coalesce("hits", F.lit(0))).select("file", reason.alias("reason")).filter("reason is not null")
    names = named_rows(locations).select(file, "repo_root", "path").groupBy("file").agg(F.min(F.struct("repo_root", "path")).alias("name"))
    return told.join(names, "file").select("name.repo_root", "name.path", "reason")
