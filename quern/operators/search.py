"""Keyword search over lines, symbol search, and extraction of definitions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.functions.text import lines_of

_ID, _TYPE = r"[A-Za-z_][A-Za-z0-9_]*", r"[A-Za-z_][A-Za-z0-9_<>\[\],.?]*"
_MEMBER = r"^\s*(?:public |private |protected |internal )"
_MODIFIERS = r"(?:public |private |protected |internal |static |final |abstract |sealed |partial |open |data |export |default )*"


def _head(word: str, modifiers: str = _MODIFIERS, name: str = _ID) -> str:
    """The pattern of a line that a word opens, with the name after it."""
    return rf"^\s*{modifiers}{word} ({name})"


#: Per language the kind of a definition and the pattern of its line (group 1: name); of several the first counts.
DEFINITIONS = (
    ("go", "function", rf"^func (?:\([^)]*\) )?({_ID})\("),
    ("go", "struct", rf"^type ({_ID}) struct"),
    ("go", "interface", rf"^type ({_ID}) interface"),
    ("python", "function", rf"^\s*(?:async )?def ({_ID})\("),
    ("python", "class", rf"^\s*class ({_ID})"),
    *[
        (lang, kind, rf"^\s*(?:export )?{word} ([A-Za-z_$][A-Za-z0-9_$]*)")
        for lang, words in (("javascript", ("function", "class")), ("typescript", ("function", "class", "interface", "type")))
        for kind, word in ((w, "(?:async )?function" if w == "function" else w) for w in words)
    ],
    *[("rust", kind, rf"^\s*(?:pub )?{word} ({_ID})") for kind, word in (("function", "fn"), ("struct", "struct"), ("enum", "enum"), ("trait", "trait"))],
    *[("java", kind, _head(kind)) for kind in ("class", "interface", "enum")],
    ("java", "function", rf"{_MEMBER}{_MODIFIERS}{_TYPE} ({_ID})\("),
    ("c", "struct", _head("struct", "(?:typedef |static )*")),
    ("c", "enum", _head("enum", "(?:typedef |static )*")),
    ("c", "type", rf"^typedef [^;]*[ *]({_ID});"),
    ("c", "function", rf"^[A-Za-z_][A-Za-z0-9_ *]*[ *]({_ID})\([^;]*$"),
    *[("cpp", kind, _head(kind, r"(?:template *<[^>]*> *)?(?:typedef |static )*")) for kind in ("class", "struct", "enum", "namespace")],
    ("cpp", "function", r"^[A-Za-z_][A-Za-z0-9_ *&:<>,]*[ *&]([A-Za-z_~][A-Za-z0-9_:~]*)\([^;]*$"),
    ("ruby", "function", r"^\s*def (?:self\.)?([a-z_][A-Za-z0-9_]*[?!=]?)"),
    *[("ruby", kind, rf"^\s*{kind} ([A-Z][A-Za-z0-9_:]*)") for kind in ("class", "module")],
    ("php", "function", rf"^\s*{_MODIFIERS}function &?({_ID})"),
    *[("php", kind, _head(kind)) for kind in ("class", "interface", "trait", "enum")],
    *[("csharp", kind, _head(kind)) for kind in ("class", "interface", "struct", "enum", "record")],
    ("csharp", "function", rf"{_MEMBER}(?:static |async |virtual |override |sealed |abstract |readonly )*{_TYPE} ({_ID})(?:<[^>]*>)?\("),
    ("kotlin", "function", rf"^\s*(?:override |suspend |inline |private |public |internal |protected |open )*fun (?:<[^>]*> )?(?:{_ID}\.)?({_ID})"),
    *[("kotlin", kind, _head(kind)) for kind in ("class", "interface", "object")],
    ("swift", "function", rf"^\s*(?:public |private |internal |open |static |override |mutating )*func ({_ID})"),
    *[("swift", kind, _head(kind)) for kind in ("class", "struct", "protocol", "enum")],
    ("shell", "function", rf"^({_ID})\(\) \{{"),
)


class SearchError(ValueError):
    """A query that cannot be run, such as an invalid pattern."""


def search_keyword(files: DataFrame, pattern: str, path: str, text: str, top_k: int = 20, ignore_case: bool = False) -> DataFrame:
    """``path, line, snippet, score``: the first ``top_k`` lines that match, with scores 100, 99, ...

    At most ``2 * top_k`` lines per file take part, as a per-file limit; order is path, then line. A
    ``top_k`` below 1 means 20. Lines are filtered before they are ranked; only the final
    ``top_k`` rows are numbered.
    """
    k = top_k if top_k > 0 else 20
    try:
        re.compile(pattern)
    except re.error as error:
        raise SearchError(f"invalid pattern: {error}") from error
    rule = f"(?i){pattern}" if ignore_case else pattern
    lines = files.select(F.col(path).alias("path"), F.posexplode(lines_of(F.col(text)))).select("path", (F.col("pos") + 1).alias("line"), F.col("col").alias("snippet")).filter(F.col("snippet").rlike(rule))
    capped = lines.withColumn("__n", F.row_number().over(W.partitionBy("path").orderBy("line"))).filter(F.col("__n") <= 2 * k)
    first = capped.orderBy("path", "line").limit(k)
    return first.select("path", "line", "snippet", (101 - F.row_number().over(W.orderBy("path", "line"))).alias("score"))


def find_symbol(symbols: DataFrame, name: str, kind: str | None = None, limit: int = 50) -> DataFrame:
    """Symbols whose name contains ``name`` without case (``%`` and ``_`` are wildcards): exact, then prefix, then others."""
    rows = symbols.filter(F.col("name").ilike(f"%{name}%"))
    if kind:
        rows = rows.filter(F.col("kind") == kind)
    low = F.lower("name")
    rank = F.when(low == name.lower(), 0).when(low.like(f"{name.lower()}%"), 1).otherwise(2)
    return rows.withColumn("match_rank", rank).orderBy("match_rank", "name", "id").limit(limit if limit > 0 else 50)


def _definition(language: str, line: Column) -> Column:
    """struct(kind, name) of the first pattern of a language that the line matches; null without any."""
    found: Column = F.lit(None).cast("struct<kind:string,name:string>")
    for _, kind, pattern in reversed([d for d in DEFINITIONS if d[0] == language]):
        name = F.regexp_extract(line, pattern, 1)
        found = F.when(name != "", F.struct(F.lit(kind).alias("kind"), name.alias("name"))).otherwise(found)
    return found


def _marked(language: str):
    return lambda line, n: F.struct((n + 1).alias("line"), _definition(language, line).alias("d"))


def extract_definitions(chunks: DataFrame, language: str, text: str, keys: list[str]) -> DataFrame:
    """``keys, line, kind, name``: definitions found by the line patterns of the chunk's language.

    The patterns run inside the array of lines, so only the definitions become rows.
    """
    languages = list(dict.fromkeys(lang for lang, *_ in DEFINITIONS))
    lines = chunks.filter(F.col(language).isin(*languages)).select(*keys, F.col(language).alias("__lang"), lines_of(F.col(text)).alias("__lines"))
    hits: Column = F.lit(None).cast("array<struct<line:int,d:struct<kind:string,name:string>>>")
    for lang in languages:
        hits = F.when(F.col("__lang") == lang, F.filter(F.transform("__lines", _marked(lang)), lambda x: x["d"].isNotNull())).otherwise(hits)
    return lines.select(*keys, F.explode(hits).alias("h")).select(*keys, "h.line", "h.d.kind", "h.d.name")


#: Prefixes that are cut from a definition's text, each once, in this order.
NAME_PREFIXES = ("func ", "function ", "def ", "class ", "interface ", "type ", "struct ", "enum ", "trait ", "const ", "let ", "var ")


def extract_name(text: Column) -> Column:
    """The name a definition's text starts with, ``unknown`` if there is none."""
    prefixes = F.array(*[F.lit(p) for p in NAME_PREFIXES])
    value = F.aggregate(prefixes, F.trim(text), lambda v, p: F.when(F.startswith(v, p), F.substr(v, F.length(p) + 1)).otherwise(v))
    name = F.regexp_extract(value, r"^[({<:=]*([^({<:=]+)", 1)
    return F.when(name != "", F.trim(name)).otherwise(F.lit("unknown"))


def parse_grep_line(line: Column) -> Column:
    """struct(path, line, content) of ``path:line:content``; null if it is not such a line."""
    path, number = F.regexp_extract(line, r"^([^:]+):(\d+):(.*)$", 1), F.regexp_extract(line, r"^([^:]+):(\d+):(.*)$", 2)
    return F.when(number != "", F.struct(path.alias("path"), number.cast("int").alias("line"), F.regexp_extract(line, r"^([^:]+):(\d+):(.*)$", 3).alias("content")))


_RECORD = "type string, data struct<path: struct<text: string>, lines: struct<text: string>, line_number: bigint>"


def relative_path(path: Column, root: str) -> Column:
    """A path below ``root`` from there on; other paths stay as they are."""
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substr(path, F.lit(len(base) + 1))).otherwise(path)


def parse_match_record(line: Column, root: str = "") -> Column:
    """struct(path, line, content) of a line search's JSON record; null for other records and malformed text."""
    record = F.from_json(line, _RECORD)
    path = record["data"]["path"]["text"]
    own = relative_path(path, root) if root not in ("", ".") else path
    content = F.regexp_replace(record["data"]["lines"]["text"], r"[\r\n]+$", "")
    return F.when(record["type"] == "match", F.struct(F.coalesce(own, F.lit("")).alias("path"), record["data"]["line_number"].cast("int").alias("line"), F.coalesce(content, F.lit("")).alias("content")))


def definition_counts(chunks: DataFrame, text: str) -> DataFrame:
    """``language, kind, lines``: how many lines the definition patterns of every language match, whatever
    the language of the chunk; one pass over the lines."""
    lines = chunks.select(F.explode(lines_of(F.col(text))).alias("t"))
    counts = [F.sum((F.regexp_extract("t", p, 1) != "").cast("bigint")).alias(str(n)) for n, (_, _, p) in enumerate(DEFINITIONS)]
    one = lines.agg(*counts)  # one row
    told = F.array(*[F.struct(F.lit(a).alias("language"), F.lit(k).alias("kind"), F.coalesce(F.col(str(n)), F.lit(0)).alias("lines")) for n, (a, k, _) in enumerate(DEFINITIONS)])
    return one.select(F.explode(told).alias("d")).select("d.*")
