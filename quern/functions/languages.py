"""Names of languages and symbol kinds, and which files are code."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language of a file extension for locations (case-sensitive, other: unknown).
LOCATION_LANGUAGES = {
    "go": "go", "py": "python", "js": "javascript", "ts": "typescript", "tsx": "typescript", "jsx": "javascript", "rs": "rust", "java": "java",
    "c": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "h": "cpp", "hpp": "cpp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin",
    "scala": "scala", "cs": "csharp", "sh": "shell", "bash": "shell", "sql": "sql", "yaml": "yaml", "yml": "yaml", "json": "json", "xml": "xml", "md": "markdown",
}
#: Language of a file extension for symbols (without case, other: null).
SYMBOL_LANGUAGES = {
    "go": "go", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "py": "python", "rs": "rust", "java": "java",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "rb": "ruby", "php": "php", "cs": "csharp", "kt": "kotlin", "swift": "swift",
}
#: Normalised kind of the kinds and one-letter kinds that symbol extractors emit.
SYMBOL_KINDS = {
    "f": "function", "func": "function", "function": "function", "method": "function",
    "c": "class", "class": "class", "s": "struct", "struct": "struct", "i": "interface", "interface": "interface",
    "t": "type", "type": "type", "typedef": "type", "v": "variable", "var": "variable", "variable": "variable",
    "const": "constant", "constant": "constant", "p": "package", "package": "package",
    "m": "field", "member": "field", "field": "field", "e": "enum", "enum": "enum", "enumerator": "enum",
}
#: Extensions of code files for incremental scans (without case), for watching and for embedding (with case).
CODE_EXTENSIONS = ("go", "js", "ts", "tsx", "jsx", "py", "rb", "java", "c", "cpp", "h", "hpp", "rs", "swift", "kt", "scala", "php", "cs", "sh", "bash", "zsh", "sql", "lua", "vim", "el")
WATCHED_EXTENSIONS = ("go", "js", "ts", "tsx", "jsx", "py", "java", "c", "cpp", "h", "hpp", "rs", "rb", "php", "swift", "kt", "scala", "cs", "md", "json", "yaml", "yml", "toml")
EMBEDDED_EXTENSIONS = ("go", "js", "ts", "tsx", "jsx", "py", "rb", "java", "c", "cpp", "h", "hpp", "rs", "swift", "kt", "scala", "php", "cs", "sh", "sql")
#: Symbol kinds that delimit chunks.
CHUNK_KINDS = ("function", "struct", "class", "type", "interface", "method")


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def extension(path: Column) -> Column:
    """Text after the last dot of the file name, empty without one."""
    return F.regexp_extract(path, r"\.([^./\\]*)$", 1)


def detect_language(path: Column) -> Column:
    """Language of a path by its extension, ``unknown`` for others and null."""
    return F.coalesce(_map(LOCATION_LANGUAGES)[extension(path)], F.lit("unknown"))


def canonical_language(language: Column) -> Column:
    """A language name without case and outer blanks; null and empty give ``unknown``."""
    name = F.lower(F.trim(language))
    return F.when(name != "", name).otherwise(F.lit("unknown"))


def normalize_kind(kind: Column) -> Column:
    """Normalised symbol kind; kinds that are not known stay as they are."""
    return F.coalesce(_map(SYMBOL_KINDS)[F.lower(kind)], kind)


def symbol_language(path: Column) -> Column:
    """Language of a path for symbol extraction; null for others."""
    return _map(SYMBOL_LANGUAGES)[F.lower(extension(path))]


def is_code_file(path: Column) -> Column:
    """Whether an incremental scan reads the file."""
    return F.lower(extension(path)).isin(*CODE_EXTENSIONS)


def is_watched_file(path: Column) -> Column:
    """Whether a change of the file starts a new run."""
    return extension(path).isin(*WATCHED_EXTENSIONS)


def is_embedded_file(path: Column) -> Column:
    """Whether the embedding run reads the file."""
    return extension(path).isin(*EMBEDDED_EXTENSIONS)
