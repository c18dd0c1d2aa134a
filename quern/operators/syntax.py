"""Cutting source files at their definitions.

Python is parsed with its own grammar; languages with braces by definition headers and matching
braces outside of strings and comments; Ruby by its ``end`` words. Definitions become chunks, a
definition of more than ``LARGE`` bytes is kept and its inner definitions are added, uncovered
runs of at least three lines become gaps, and files without a grammar are cut into line windows.
Runs as an Arrow map over whole files.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

LARGE, GAP_LEAST = 2000, 3


class Chunk(NamedTuple):
    start_line: int
    end_line: int
    start_byte: int
    end_byte: int
    content: str
    content_hash: str
    node_type: str
    node_name: str
    language: str


#: Language by extension, and node types by header pattern (group 1: name).
GRAMMARS = {"go": "go", "py": "python", "js": "javascript", "mjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "rs": "rust", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "rb": "ruby"}
_ID = r"([A-Za-z_$][\w$]*)"
HEADERS = {
    "go": [("method_declaration", rf"func \([^)]*\) {_ID}"), ("function_declaration", rf"func {_ID}"), ("type_declaration", rf"type {_ID}"), ("const_declaration", rf"const {_ID}?"), ("var_declaration", rf"var {_ID}?")],
    "javascript": [("function_declaration", rf"(?:async )?function\*? {_ID}"), ("class_declaration", rf"class {_ID}"), ("export_statement", rf"export (?:default )?(?:async )?(?:function\*?|class|const|let|var)? ?{_ID}?"), ("arrow_function", rf"(?:const|let|var) {_ID} = (?:async )?(?:\([^)]*\)|\w+) =>"), ("method_definition", rf"(?!(?:if|for|while|switch|catch|function|return)\b)(?:(?:static|async|get|set) )*{_ID}\([^)]*\) \{{")],
    "rust": [("function_item", rf"(?:pub(?:\([a-z]+\))? )?(?:async |unsafe |const )*fn {_ID}"), ("impl_item", rf"impl(?:<[^>]*>)? {_ID}"), ("struct_item", rf"(?:pub )?struct {_ID}"), ("enum_item", rf"(?:pub )?enum {_ID}"), ("trait_item", rf"(?:pub )?trait {_ID}"), ("mod_item", rf"(?:pub )?mod {_ID}")],
    "java": [("class_declaration", rf"(?:(?:public|private|protected|static|final|abstract) )*class {_ID}"), ("interface_declaration", rf"(?:(?:public|private|protected|static) )*interface {_ID}"), ("method_declaration", rf"(?:(?:public|private|protected|static|final|abstract|synchronized) )+[\w<>\[\], ]+ {_ID}\s*\("), ("constructor_declaration", rf"(?:public|private|protected) {_ID}\s*\(")],
    "c": [("struct_specifier", rf"(?:typedef )?struct {_ID}"), ("enum_specifier", rf"(?:typedef )?enum {_ID}"), ("function_definition", rf"(?:[A-Za-z_][\w \*]*[ \*]){_ID}\s*\([^;]*$")],
    "cpp": [("class_specifier", rf"class {_ID}"), ("struct_specifier", rf"struct {_ID}"), ("namespace_definition", rf"namespace {_ID}"), ("function_definition", rf"(?:[A-Za-z_][\w:<> \*&]*[ \*&]){_ID}\s*\([^;]*$")],
    "ruby": [("class", rf"class {_ID}"), ("module", rf"module {_ID}"), ("method", r"def (?:self\.)?([\w?!=]+)")],
}
HEADERS["typescript"] = [("interface_declaration", rf"(?:export )?interface {_ID}"), ("type_alias_declaration", rf"(?:export )?type {_ID}"), *HEADERS["javascript"]]
_COMPILED = {lang: [(kind, re.compile(r"\s*" + p)) for kind, p in rules] for lang, rules in HEADERS.items()}
_NOISE = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|//[^\n]*|/\*.*?\*/", re.S)


def language_of(path: str) -> str:
    return GRAMMARS.get(path.rsplit(".", 1)[-1].lower() if "." in path else "", "unknown")


def _python(text: str) -> list[tuple[int, int, str, str]]:
    """(first line, last line, type, name) of definitions, nested ones only inside large ones."""
    out: list[tuple[int, int, str, str]] = []
    lines = text.splitlines(keepends=True)

    def walk(body: list) -> None:
        for node in body:
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
                kind = "decorated_definition" if node.decorator_list else "class_definition" if isinstance(node, ast.ClassDef) else "function_definition"
                out.append((first, node.end_lineno or node.lineno, kind, node.name))
                if len("".join(lines[first - 1 : node.end_lineno]).encode()) <= LARGE:
                    continue
            walk([n for n in ast.iter_child_nodes(node) if isinstance(n, ast.stmt)])

    walk(ast.parse(text).body)
    return out


def _braces(text: str, language: str) -> list[tuple[int, int, str, str]]:
    """Definitions found by their headers, each to the line of the matching brace."""
    blank = _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    lines, out, n = blank.split("\n"), [], 0
    skip_to = 0
    while n < len(lines):
        hit = next(((k, m) for k, p in _COMPILED[language] if (m := p.match(lines[n]))), None)
        if hit is None or n < skip_to:
            n += 1
            continue
        depth, seen, end = 0, False, n
        for end in range(n, len(lines)):
            depth += lines[end].count("{") - lines[end].count("}") + lines[end].count("(") - lines[end].count(")")
            seen = seen or "{" in lines[end]
            if depth <= 0 and (seen or lines[end].rstrip().endswith((";", ")")) or (end > n and not lines[end].strip())):
                break
        kind, m = hit
        out.append((n + 1, end + 1, kind, (m[1] if m.lastindex and m[1] else "")))
        if len("\n".join(text.split("\n")[n : end + 1]).encode()) <= LARGE:
            skip_to = end + 1
        n += 1
    return out


def _ruby(text: str) -> list[tuple[int, int, str, str]]:
    lines, out = text.split("\n"), []
    for n, line in enumerate(lines):
        for kind, p in _COMPILED["ruby"]:
            if m := p.match(line):
                indent = len(line) - len(line.lstrip())
                end = next((e for e in range(n + 1, len(lines)) if re.match(rf"\s{{{indent}}}end\b", lines[e])), n)
                out.append((n + 1, end + 1, kind, m[1]))
                break
    return out


def windows(count: int, size: int, overlap: int) -> list[tuple[int, int]]:
    out, start = [], 0
    while start < count:
        end = min(start + size, count)
        out.append((start + 1, end))
        if end == count:
            break
        start += max(1, size - overlap)
    return out


def chunk_file(path: str, text: str | None, fallback_size: int = 50, fallback_overlap: int = 10, gaps: bool = True) -> list[Chunk]:
    """Chunks of a file in the order of their lines; null and empty files have none."""
    if not text:
        return []
    language = language_of(path)
    lines = text.split("\n")
    offsets = [0]
    for x in lines:
        offsets.append(offsets[-1] + len(x.encode()) + 1)
    try:
        found = _python(text) if language == "python" else _ruby(text) if language == "ruby" else _braces(text, language) if language in _COMPILED else []
    except (SyntaxError, ValueError, RecursionError):
        found = []

    def make(a: int, b: int, kind: str, name: str, lang: str) -> Chunk:
        content = "\n".join(lines[a - 1 : b])
        return Chunk(a, b, offsets[a - 1], offsets[b] - 1, content, hashlib.sha256(content.encode("utf-8", "surrogatepass")).hexdigest(), kind, name, lang)

    if not found:
        return [make(a, b, "block", "", language) for a, b in windows(len(lines), fallback_size, fallback_overlap)]
    covered = {n for a, b, *_ in found for n in range(a, b + 1)}
    chunks = [make(a, min(b, len(lines)), k, name, language) for a, b, k, name in found]
    if gaps:
        start = None
        for n in range(1, len(lines) + 2):
            if n <= len(lines) and n not in covered:
                start = start or n
            elif start:
                if n - start >= GAP_LEAST:
                    chunks.append(make(start, n - 1, "gap", "", language))
                start = None
    return sorted(chunks, key=lambda c: (c.start_line, c.start_byte, -c.end_line))


SCHEMA = "start_line int, end_line int, start_byte int, end_byte int, content string, content_hash string, node_type string, node_name string, language string"


def chunk_syntax(files: DataFrame, keys: tuple[str, ...] = ("repo_root", "path"), text: str = "content", **options) -> DataFrame:
    """``keys`` and the fields of ``Chunk`` for every chunk of every file."""
    fields = ", ".join(f"{k} {files.schema[k].dataType.simpleString()}" for k in keys)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*k, *c) for *k, t in batch[[*keys, text]].itertuples(index=False) for c in chunk_file(str(k[-1]), t, **options)]
            yield pd.DataFrame(rows, columns=[*keys, *Chunk._fields])

    return files.select(*keys, text).mapInPandas(cut, f"{fields}, {SCHEMA}")
