"""Configuration formats as key paths with offsets: JSON, YAML, TOML, properties, INI and XML.

The parsers never fail: they read fragments of files, keep going after mistakes, and say which
parts they could not read. Every text is given with one character per byte, so offsets are byte
offsets. An ``Entry`` is a scalar with the path of keys that leads to it (items of lists by their
number); a ``Rest`` is a comment or something that is no entry.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple


#: Keys of a path that are kept, the innermost ones; deeper nesting would cost its square.
DEEPEST = 16


class Entry(NamedTuple):
    """A scalar: its key path (the last ``DEEPEST`` keys) and the range of its text without quotes."""

    path: tuple[str, ...]
    start: int
    end: int


class Rest(NamedTuple):
    """A comment, or text that is no entry."""

    start: int
    end: int


#: Formats by extension.
FORMATS = {
    "json": "json", "json5": "json", "jsonc": "json", "yml": "yaml", "yaml": "yaml", "toml": "toml",
    "properties": "properties", "env": "properties", "ini": "properties", "cfg": "properties", "conf": "properties",
    "xml": "xml", "plist": "xml", "config": "xml",
}


def format_of(path: str | None) -> str | None:
    """The format of a file by its name; None for other files."""
    name = (path or "").replace("\\", "/").rsplit("/", 1)[-1].lower()
    if name.startswith(".env"):
        return "properties"
    return FORMATS.get(name.rsplit(".", 1)[-1]) if "." in name else None


_OPENS_YAML = re.compile(r"(?m)^[ \t]*(?:- )?[A-Za-z_][\w.\-]*:(?:[ \t]|$)")
_OPENS_TABLE = re.compile(r"(?m)^[ \t]*\[{1,2}[\w.\- \"]+\]{1,2}[ \t\r]*$")


def sniff(text: str) -> str | None:
    """The format a text within other text is written in, as far as its looks tell."""
    bare = text.lstrip()
    if bare[:1] in "{[" and re.match(r"[{\[]\s*(?:[\"'{\[\]}]|$)", bare):
        return "json"
    if bare[:1] == "<":
        return "xml"
    if _OPENS_TABLE.search(text) and "=" in text:
        return "toml"
    return "yaml" if len(_OPENS_YAML.findall(text)) >= 2 else None


def entries(text: str, form: str) -> list[Entry | Rest]:
    """All entries and rests of a text of one of the formats, in order."""
    return list(_PARSERS[form](text))


def _bare(text: str) -> str:
    """A key without its quotes."""
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


# JSON, and the flow collections and inline tables of YAML and TOML

_TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z)|(?:(?<=\s)|(?<=,)|^)\#[^\n]*)
      | (?P<string>"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?)
      | (?P<mark>[{}\[\],])
      | (?P<colon>:)
      | (?P<plain>[^\s{}\[\],:"'][^\n{}\[\],:"']*(?::(?=[^\s\[\]{},])[^\n{}\[\],"':]*)*)""",
    re.S | re.X | re.M,
)
_KEY_ENDS = re.compile(r"\s*(?::(?=[\s\"'{\[]|$|[^/])|=)")


def _flow(text: str, at: int, base: tuple[str, ...], whole: bool) -> Iterator[Entry | Rest | int]:
    """The scalars of a collection that begins at ``at``; the last thing given is the offset of its end.

    ``whole`` reads to the end of the text, as for a JSON file or a fragment of one.
    """
    frames: list[list] = [[None, 0, False]] if whole else []  # key, number of the next item, is a list
    end = len(text)
    while m := _TOKEN.search(text, at):
        at = m.end()
        if m.lastgroup == "comment":
            yield Rest(*m.span())
        elif m.lastgroup == "mark":
            sign = m[0]
            if sign in "{[":
                frames.append([None, 0, sign == "["])
            elif sign == ",":
                if frames:
                    frames[-1][0] = None
                    frames[-1][1] += 1
            else:
                if len(frames) > 1 or not whole:
                    frames.pop()
                if not frames:
                    end = at
                    break
        elif m.lastgroup in ("string", "plain"):
            start, stop = m.span()
            token = m[0]
            if m.lastgroup == "plain":
                cut = re.search(r"\s+(?://|#)", token)
                token = (token[: cut.start()] if cut else token).rstrip()
                at, stop = start + len(token), start + len(token)
                if "=" in token and not frames[-1][2] and frames[-1][0] is None:
                    # a bare key of an inline table
                    token = token[: token.index("=")].rstrip()
                    at = stop = start + len(token)
            if frames and not frames[-1][2] and frames[-1][0] is None and (k := _KEY_ENDS.match(text, stop)):
                frames[-1][0] = _bare(token)
                at = k.end()
                continue
            quoted = token[:1] in "\"'"
            closed = quoted and len(token) > 1 and token[-1] == token[0]
            yield Entry(base + _trail(frames), start + quoted, stop - closed)
    yield end


def _trail(frames: list[list]) -> tuple[str, ...]:
    return tuple(str(f[1]) if f[2] else f[0] for f in frames[-DEEPEST:] if f[2] or f[0] is not None)


def _json(text: str) -> Iterator[Entry | Rest]:
    for found in _flow(text, 0, (), True):
        if not isinstance(found, int):
            yield found


def _collection(text: str, at: int, base: tuple[str, ...]) -> tuple[list[Entry | Rest], int]:
    *found, end = _flow(text, at, base, False)
    return found, end


# YAML

_YAML_KEY = re.compile(r"""("(?:[^"\\\n]|\\.)*"|'(?:[^'\n]|'')*'|(?![#&*!|>%@`"'\[\]{},]|-\s)[^\n]*?)[ \t]*:(?=[ \t\r]|$)""", re.M)
_YAML_TAGS = re.compile(r"(?:[&!][^\s,\[\]{}]*[ \t]*)+")
_BLOCK = re.compile(r"[|>][+\-0-9]*[ \t]*(#[^\n]*)?\r?$", re.M)
_SPACED_COMMENT = re.compile(r"[ \t]#")


def _line_end(text: str, at: int) -> int:
    end = text.find("\n", at)
    return len(text) if end < 0 else end


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _yaml(text: str) -> Iterator[Entry | Rest]:
    # frames: column, key (None in a list), number of the item
    frames: list[list] = []
    at, size = 0, len(text)

    def path() -> tuple[str, ...]:
        return tuple(str(f[2]) if f[1] is None else f[1] for f in frames[-DEEPEST:])

    while at < size:
        begin, end = at, _line_end(text, at)
        at = end + 1
        line = text[begin:end].rstrip("\r")
        bare = line.strip()
        if not bare:
            continue
        if bare.startswith(("---", "...", "%")) and line[0] == bare[0]:
            frames.clear()
            if len(bare) > 3:
                yield Rest(begin + 3, begin + len(line))
            continue
        if bare[0] == "#":
            yield Rest(begin, begin + len(line))
            continue
        column = len(line) - len(line.lstrip(" \t"))
        fresh = False  # a list item or key that opened on this line
        while (rest := line[column:]).startswith(("- ", "-\t")) or rest == "-":
            while frames and (frames[-1][0] > column or (frames[-1][0] == column and frames[-1][1] is not None and fresh)):
                frames.pop()
            if frames and frames[-1][0] == column and frames[-1][1] is None:
                frames[-1][2] += 1
            elif frames and frames[-1][0] == column and not fresh:
                # the list of a key may stand in the column of the key
                frames.append([column, None, 0])
            else:
                while frames and frames[-1][0] >= column:
                    frames.pop()
                frames.append([column, None, 0])
            after = rest[1:]
            column += 1 + len(after) - len(after.lstrip(" \t"))
            fresh = True
        if column >= len(line):
            continue
        m = _YAML_KEY.match(line, column)
        if m:
            while frames and (frames[-1][0] > column or (frames[-1][0] == column and not (frames[-1][1] is None and fresh))):
                frames.pop()
            frames.append([column, _bare(m[1]), 0])
            start = m.end()
        else:
            # a scalar below its key, or an item of a list
            while not fresh and frames and frames[-1][0] >= column:
                frames.pop()
            start = column
            if not frames:
                yield Rest(begin + column, begin + len(line))
                continue
        start += len(line[start:]) - len(line[start:].lstrip(" \t"))
        if tags := _YAML_TAGS.match(line, start):
            start = tags.end()
        value, first = line[start:], begin + start
        if not value or value[0] == "#":
            if value:
                yield Rest(first, begin + len(line))
            continue
        if value[0] == "*":
            continue
        if _BLOCK.match(value):
            stop = last = end + 1
            inner = None
            while stop < size:
                e = _line_end(text, stop)
                own = text[stop:e]
                if own.strip():
                    depth = _indent(own)
                    if depth <= frames[-1][0] or (inner is not None and depth < inner):
                        break
                    inner, last = depth if inner is None else inner, e
                stop = e + 1
            if inner is not None:
                begin_of_text = end + 1
                while not text[begin_of_text : _line_end(text, begin_of_text)].strip():
                    begin_of_text = _line_end(text, begin_of_text) + 1
                yield Entry(path(), begin_of_text + inner, last - (text[last - 1] == "\r"))
            at = max(stop, end + 1)
        elif value[0] in "\"'":
            quote = re.compile(r'"(?:[^"\\]|\\.)*"' if value[0] == '"' else r"'(?:[^']|'')*'", re.S).match(text, first)
            if quote is None:
                yield Entry(path(), first + 1, begin + len(line))
                continue
            yield Entry(path(), quote.start() + 1, quote.end() - 1)
            end = _line_end(text, quote.end())
            if text[quote.end() : end].strip():
                yield Rest(quote.end(), end)
            at = end + 1
        elif value[0] in "{[":
            found, stop = _collection(text, first, path())
            yield from found
            at = _line_end(text, stop) + 1
            if text[stop : at - 1].strip():
                yield Rest(stop, at - 1)
        else:
            cut = _SPACED_COMMENT.search(value)
            stop = first + len((value[: cut.start()] if cut else value).rstrip())
            if cut:
                yield Rest(first + cut.start(), begin + len(line))
            else:
                # plain scalars go on in deeper lines that are neither keys nor items
                while at < size:
                    e = _line_end(text, at)
                    own = text[at:e].rstrip("\r")
                    deep = len(own) - len(own.lstrip(" \t"))
                    if not own.strip() or deep <= frames[-1][0] or own.lstrip()[0] in "#-" or _YAML_KEY.match(own, deep):
                        break
                    stop, at = at + len(own.rstrip()), e + 1
            yield Entry(path(), first, stop)


# TOML

_TOML_TABLE = re.compile(r"[ \t]*\[{1,2}[ \t]*([^\[\]\n]+?)[ \t]*\]{1,2}[ \t]*(?:#[^\n]*)?\r?$", re.M)
_TOML_KEY = re.compile(r"""[ \t]*((?:"(?:[^"\\\n]|\\.)*"|'[^'\n]*'|[\w\-\x80-\xff]+)(?:[ \t]*\.[ \t]*(?:"(?:[^"\\\n]|\\.)*"|'[^'\n]*'|[\w\-\x80-\xff]+))*)[ \t]*=[ \t]*""")
_TOML_PART = re.compile(r"""("(?:[^"\\\n]|\\.)*"|'[^'\n]*'|[\w\-\x80-\xff]+)""")
_TOML_LONG = re.compile(r'"""(?P<a>(?:[^\\"]|\\.|"(?!""))*)(?:"""|\Z)|\'\'\'(?P<b>(?:[^\']|\'(?!\'\'))*)(?:\'\'\'|\Z)', re.S)
_ONE_LINE = re.compile(r'"(?P<a>(?:[^"\\\n]|\\.)*)"?|\'(?P<b>[^\'\n]*)\'?')


def _toml(text: str) -> Iterator[Entry | Rest]:
    table: tuple[str, ...] = ()
    at, size = 0, len(text)
    while at < size:
        end = _line_end(text, at)
        begin, at = at, end + 1
        bare = text[begin:end].strip()
        if not bare:
            continue
        if m := _TOML_TABLE.match(text, begin):
            table = tuple(_bare(p) for p in _TOML_PART.findall(m[1]))
            continue
        m = _TOML_KEY.match(text, begin, end)
        if bare[0] == "#" or m is None:
            yield Rest(begin, end)
            continue
        path, first = table + tuple(_bare(p) for p in _TOML_PART.findall(m[1])), m.end()
        if first < size and text[first] in "[{":
            found, stop = _collection(text, first, path)
            yield from found
        elif quoted := _TOML_LONG.match(text, first) or _ONE_LINE.match(text, first, end):
            yield Entry(path, *quoted.span(quoted.lastgroup))
            stop = quoted.end()
        else:
            cut = _SPACED_COMMENT.search(text, first, end)
            stop = cut.start() if cut else end
            yield Entry(path, first, first + len(text[first:stop].rstrip()))
        end = _line_end(text, stop)
        at = end + 1
        if text[stop:end].strip():
            yield Rest(stop, end)


# properties, environment files and INI

_SECTION = re.compile(r"[ \t]*\[([^\[\]\n=]+)\][ \t]*\r?$", re.M)
_SETTING = re.compile(r"""[ \t]*(?:export[ \t]+|set[ \t]+)?(?P<key>(?:"[^"\n]*"|'[^'\n]*'|(?:[^\s=:#;!\\]|\\.|[ \t](?=[\w.\-]+[ \t]*[=:]))+))[ \t]*[=:][ \t]*""")
_GOES_ON = re.compile(r"(?<!\\)(?:\\\\)*\\\r?\Z")
_LONG = re.compile(r'"(?P<a>(?:[^"\\]|\\.)*)"|\'(?P<b>[^\']*)\'', re.S)


def _properties(text: str) -> Iterator[Entry | Rest]:
    section: tuple[str, ...] = ()
    at, size = 0, len(text)
    while at < size:
        end = _line_end(text, at)
        begin, at = at, end + 1
        bare = text[begin:end].strip()
        if not bare:
            continue
        if m := _SECTION.match(text, begin):
            section = (m[1].strip(),)
            continue
        m = _SETTING.match(text, begin, end)
        if bare[0] in "#;!" or m is None:
            yield Rest(begin, end)
            continue
        path, first = (*section, _bare(m["key"])), m.end()
        if first < end and text[first] in "\"'":
            quoted = _ONE_LINE.match(text, first, end)
            closed = len(quoted[0]) > 1 and quoted[0][-1] == quoted[0][0]
            if not closed and (longer := _LONG.match(text, first)) and not re.search(r"\n[ \t]*[\w.]+[ \t]*=", longer[0]):
                quoted = longer
            yield Entry(path, *quoted.span(quoted.lastgroup))
            end = _line_end(text, quoted.end())
            at = end + 1
            if text[quoted.end() : end].strip():
                yield Rest(quoted.end(), end)
            continue
        cut = _SPACED_COMMENT.search(text, first, end)
        stop = cut.start() if cut else end
        if cut:
            yield Rest(cut.start(), end)
        # a line that ends in a backslash goes on in the next one
        begin = first
        while not cut and at < size and _GOES_ON.search(text[begin:stop]):
            begin, stop = at, _line_end(text, at)
            at = stop + 1
        yield Entry(path, first, first + len(text[first:stop].rstrip().rstrip("\\").rstrip()))


# XML

_NODE = re.compile(r"<!--(?P<comment>.*?)(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<(?P<close>/?)(?P<name>[A-Za-z_\x80-\xff][\w.\-:\x80-\xff]*)(?P<rest>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)>|<[?!][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"""([A-Za-z_\x80-\xff][\w.\-:\x80-\xff]*)\s*=\s*("[^"]*"|'[^']*')""")


def _xml(text: str) -> Iterator[Entry | Rest]:
    frames: list[str] = []
    at = number = 0

    def between(start: int, end: int) -> Iterator[Entry | Rest]:
        own = text[start:end]
        if own.strip():
            start += len(own) - len(own.lstrip())
            end = start + len(own.strip())
            yield Entry(tuple(frames[-DEEPEST:]), start, end) if frames else Rest(start, end)

    for m in _NODE.finditer(text):
        yield from between(at, m.start())
        at = m.end()
        if m["comment"] is not None:
            yield Rest(*m.span("comment"))
        elif m["data"] is not None:
            yield from between(*m.span("data"))
        elif m["name"]:
            if m["close"]:
                # a tag that was never opened closes nothing
                for n in range(len(frames) - 1, max(-1, len(frames) - 1 - DEEPEST), -1):
                    if frames[n].rsplit("#", 1)[0] == m["name"]:
                        del frames[n:]
                        break
                continue
            number += 1
            frames.append(f"{m['name']}#{number}")
            for a in _ATTRIBUTE.finditer(m["rest"]):
                start = m.start("rest") + a.start(2)
                yield Entry((*frames[-DEEPEST:], a[1]), start + 1, start + len(a[2]) - 1)
            if m["rest"].endswith("/"):
                frames.pop()
    yield from between(at, len(text))


_PARSERS = {"json": _json, "yaml": _yaml, "toml": _toml, "properties": _properties, "xml": _xml}
