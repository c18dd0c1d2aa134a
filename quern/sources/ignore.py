"""Ignore rules for directory scans: fixed names, hidden files and gitignore patterns."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that a tree scan never enters or reads.
IGNORED_NAMES = (".git", ".svn", ".hg", "node_modules", "vendor", "bower_components", "dist", "build", "out", "target", "bin", "__pycache__", ".pytest_cache", ".mypy_cache", ".tox", ".cache", ".idea", ".vscode", ".vs", ".DS_Store", "Thumbs.db")
#: Hidden names that are read nevertheless.
HIDDEN_ALLOWED = (".gitignore", ".dockerignore", ".editorconfig", ".prettierrc", ".eslintrc", ".eslintrc.json", ".eslintrc.js")
#: Directories an incremental scan skips.
SCAN_IGNORED = ("node_modules", "vendor", "dist", "build", "target", "__pycache__", ".git", ".svn", ".hg")
#: Directories that are not watched.
WATCH_IGNORED = (
    ".git", ".svn", ".hg", ".idea", ".vscode", "dist", "build", "target", "out", "node_modules", "vendor", ".bundle", "Pods", "__pycache__", ".venv", "venv", "env", ".tox", ".pytest_cache",
    "tmp", "log", "coverage", "sorbet", ".cache", ".next", ".nuxt", ".turbo", ".parcel-cache", "public/assets", "public/packs",
)


def parse_gitignore(content: str) -> list[str]:
    """The patterns of a gitignore file: no comments, no blank lines, trailing blanks cut."""
    out = []
    for line in content.splitlines():
        line = line.rstrip("\r").lstrip()
        if line.strip() and not line.startswith("#"):
            out.append(re.sub(r"(?<!\\) +$", "", line))
    return out


def load_gitignore(root: str) -> list[str]:
    """Patterns of the user's and the repository's gitignore; missing files have none."""
    found = []
    for file in (Path.home() / ".gitignore", Path(root) / ".gitignore"):
        if file.is_file():
            found += parse_gitignore(file.read_text(errors="replace"))
    return found


def pattern_regex(pattern: str) -> str:
    """A regular expression over relative paths (with ``/``) for one gitignore pattern."""
    body = pattern.lstrip("!")
    anchored = "/" in body.rstrip("/")
    folder = body.endswith("/")
    body = body.strip("/")
    out, n = "", 0
    while n < len(body):
        c = body[n]
        if body.startswith("**/", n):
            out, n = out + "(?:.*/)?", n + 3
            continue
        if body.startswith("**", n):
            out, n = out + ".*", n + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in body[n + 1 :]:
            end = body.index("]", n + 1)
            inside = body[n + 1 : end]
            out, n = out + "[" + ("^" + inside[1:] if inside.startswith("!") else inside) + "]", end
        elif c == "\\" and n + 1 < len(body):
            n += 1
            out += re.escape(body[n])
        else:
            out += re.escape(c)
        n += 1
    return ("^" if anchored else "(?:^|.*/)") + out + ("/.*$" if folder else "(?:/.*)?$")


def ignored_by(path: Column, patterns: list[str]) -> Column:
    """Whether the last pattern that matches a relative path ignores it (``!`` takes back)."""
    result: Column = F.lit(False)
    for p in patterns:
        result = F.when(path.rlike(pattern_regex(p)), F.lit(not p.startswith("!"))).otherwise(result)
    return result


def default_ignored(path: Column, extra: tuple[str, ...] = (), include_hidden: bool = False) -> Column:
    """Whether any segment of a relative path is an ignored or a hidden name."""
    names = [*IGNORED_NAMES, *extra]
    hidden = (lambda s: F.lit(False)) if include_hidden else (lambda s: F.startswith(s, F.lit(".")) & ~s.isin(*HIDDEN_ALLOWED))
    return F.exists(F.split(path, "/"), lambda s: s.isin(*names) | hidden(s))
