"""Credentials embedded in source code and configuration (problem 1).

Method: configuration (JSON, YAML, TOML, properties, INI, XML) is parsed into key paths with byte
offsets (``formats``); of other texts the lines are read as assignments, as are comments and
strings in configuration. An entry is a credential if its key path names a secret and the value
has the shape of a literal (no placeholder, look-up, setting or plain word). Apart from keys, some
values give themselves away: provider token shapes, signed tokens, URLs and connection strings with
a password, authorization headers, command options, private key blocks. Redactions are spliced into
the original bytes, so everything else stays as it is; they consist of letters only, so that every
format still parses.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.formats import FORMATS, Rest, entries, format_of, sniff
from quern.runtime import spread

#: Words that name a secret wherever they stand in a key.
_SECRET_WORDS = {"password", "passwd", "passphrase", "passwort", "kennwort", "pwd", "pw", "pass", "passe", "clave", "contrasena", "contraseña", "secret", "secrets", "credential", "credentials", "apikey", "privatekey", "accesskey", "authkey", "authtoken", "accesstoken", "psk"}
#: Words that make a following "key" a secret, and a following "token" one.
_KEY_OF = {"api", "secret", "private", "access", "signing", "sign", "encryption", "encrypt", "hmac", "license", "licence", "master", "auth", "shared", "account", "storage", "service", "deploy", "jwt", "session", "crypto", "aes", "rsa", "webhook", "cookie"}
_TOKEN_OF = {"auth", "access", "api", "bot", "private", "refresh", "bearer", "oauth", "github", "gitlab", "slack", "npm", "vault", "deploy", "personal", "security", "app", "service", "registry", "csrf", "jwt", "webhook"}
#: Words that, at the end of a key, make it a setting of a secret.
_SETTING = {"id", "name", "names", "ttl", "length", "len", "min", "max", "header", "path", "file", "files", "filename", "url", "uri", "endpoint", "ref", "hash", "digest", "count", "type", "kind", "version", "expiry", "expires", "expiration", "age", "days", "policy", "timeout", "prefix", "suffix", "env", "arn", "region", "location", "dir", "enabled", "required", "rotation", "public", "pub", "size", "format", "field", "column", "index", "store", "manager", "provider", "source", "mode", "hint", "label", "prompt", "regex", "pattern", "rules", "limit", "scope", "user", "username"}
#: Shapes of provider tokens, each with the prefixes it can begin with.
_TOKENS = {
    r"gh[pousr]_[A-Za-z0-9]{18,}": "ghp_ gho_ ghu_ ghs_ ghr_",
    r"github_pat_\w{20,}": "github_pat_",
    r"glpat-[\w\-]{18,}": "glpat-",
    r"gl(?:dt|rt|ptt|cbt)-[\w\-]{18,}": "gldt- glrt- glptt- glcbt-",
    r"xox[abeprs]-[A-Za-z0-9\-]{10,}": "xoxa- xoxb- xoxe- xoxp- xoxr- xoxs-",
    r"xapp-[A-Za-z0-9\-]{20,}": "xapp-",
    r"(?:sk|rk|pk)_live_[A-Za-z0-9]{16,}": "sk_live_ rk_live_ pk_live_",
    r"(?:sk|pk|rk)-(?:[a-z]{2,8}-){0,2}[A-Za-z0-9]{18,}": "sk- pk- rk-",
    r"dop_v1_[A-Za-z0-9]{16,}": "dop_v1_",
    r"npm_[A-Za-z0-9]{18,}": "npm_",
    r"pypi-[\w\-]{20,}": "pypi-",
    r"hf_[A-Za-z0-9]{20,}": "hf_",
    r"shp(?:at|ss|ca|pa)_[A-Fa-f0-9]{30,}": "shpat_ shpss_ shpca_ shppa_",
    r"AIza[\w\-]{35}": "AIza",
    r"ya29\.[\w\-]{20,}": "ya29.",
    r"SG\.[\w\-]{20,}\.[\w\-]{20,}": "SG.",
    r"hv[sb]\.[\w\-]{20,}": "hvs. hvb.",
    r"dckr_pat_[\w\-]{20,}": "dckr_pat_",
    r"key-[0-9a-f]{32}": "key-",
}
_PROVIDER = re.compile(r"(?<![A-Za-z0-9_\-])(?:" + "|".join(_TOKENS) + r")(?![A-Za-z0-9_\-])")
_ACCESS_ID = re.compile(r"(?<![A-Za-z0-9/+_\-])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9/+=])")
_SIGNED = re.compile(r"(?<![\w\-.])eyJ[\w\-]{8,}\.eyJ[\w\-]{4,}\.[\w\-]{10,}")
_URL = re.compile(r"(?<=[A-Za-z0-9+.\-])://([^\s/@:'\"<>`]*):([^\s/'\"<>`]+?)@(?=[\w\[])")
#: Parts of connection strings that hold a secret, and commands with short options that do.
_PARTS = ("password", "pwd", "sharedaccesskey", "accountkey", "sharedsecret", "sharedaccesssignature")
_COMMANDS = ("mysql", "mariadb", "sshpass", "psql", "redis-cli", "mongo", "7z", "zip", "unzip", "ldapsearch", "smbclient")
_CONNECTION = re.compile(r"(?i)(?:^|[;\s\"'>=])(?:" + "|".join(_PARTS) + r")\s*=\s*([^;\"'<>\s]+)")
_HEADER = re.compile(r"(?i)\b(?:authorization|x-api-key|x-auth-token|private-token|x-vault-token|proxy-authorization)\b[\"']?\]?\s*[:=,>]{1,2}\s*[\"'`]?(?:(basic|bearer|token|apikey)\s+)?([^\s\"'`<>,;]+)")
_SCHEME = re.compile(r"(?i)[\"'`>\s=](basic|bearer|token)\s+([A-Za-z0-9+/_\-.=~]{12,})")
_OPTION = re.compile(r"(?i)(?<![\w\-])--?(?:password|passwd|pass|pwd|secret|token|api[_\-]?key|access[_\-]?token|auth[_\-]?token|client[_\-]?secret|secret[_\-]?key)(?:\s*=\s*|\s+)[\"']?([^\s\"']+)")
#: A command and what follows it up to the next one of the line; options are looked for in there.
_RUN = re.compile(r"(?<![\w\-])(?:" + "|".join(c + r"\w*" if c in ("mysql", "mongo") else c for c in _COMMANDS) + r")\b([^\n|;]*)")
_SHORT = re.compile(r"\s-(?:p|a|w|P)\s?[\"']?([^\s\"'\-][^\s\"']{5,})")
_FETCH = re.compile(r"(?<![\w\-])(?:curl|wget|http)\b([^\n|;]*)")
_USER_OPTION = re.compile(r"\s(?:-u|--user)[\s=][\"']?([^\s:\"']+):([^\s\"']+)")
_PROSE = re.compile(r"(?i)\b(?:log-?in|creds?|credentials?|passw(?:or)?[dt]|kennwort|clave|secret)\b[^\n:=>]{0,40}?(?::|=>|->|=| is )\s*(?:[\w.\-]+\s*[/ ,]\s*)?[\"'`]?([^\s\"'`,]{8,})")
#: A comment that ends in an account and its password.
_PAIR = re.compile(r"""^[ \t]*(?:\#|//|<!--|--|;|/?\*)[^\n]*?(?::|->|=>|\b(?:is|ist|est|es|are|sind|lautet))[ \t]+([a-z][\w.\-]*)[ \t]*[ \t/:][ \t]*([^\s(\[<{"'`/][^\s"'`]{5,}?)[ \t]*(?:-->|\*/)?[ \t\r]*$""", re.M)
_ACCOUNT = re.compile(r"(?:ops|deploy|admin|root|app|etl|reader|writer|backup|service|guest|user)\w*|svc\w*|\w+_\w+")
_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_BODY = re.compile(r"[A-Za-z0-9+/]{24,}")
#: What may surround a line of key material: comment signs, quotes, escaped line breaks, joins.
_DRESS = re.compile(r"""^[ \t]*(?:\#|//|\*|--|>)?[ \t]*["'`]?(?:\\[nr])*|(?:\\[nr])*["'`]?[ \t]*[+,.;\\]*[ \t\r]*$""")
_MATERIAL = re.compile(r"[A-Za-z0-9+/=\\]+")
_ESCAPED = re.compile(r"(?:\\[nr]|[A-Za-z0-9+/=])*")  # a block on one line, with escaped line breaks
_PEM_HEADER = re.compile(r"(?:Proc-Type|DEK-Info|Version|Comment|Charset|Hash|MessageID):")

#: Keys begin with the run of signs they consist of, or after its leading dashes and dots: looked for
#: at every letter, a long word would cost its square.
_STARTS = r"(?:(?<![\w.\-])|(?<=[^\w.\-][.\-])|(?<=--))"
#: Keys may hold the second byte of ñ, which is no letter by itself.
_ENTRY = re.compile(
    r"""(?P<q>["'`]?)""" + _STARTS + r"""(?P<key>[A-Za-z_][\w.\-\xb1]*)(?P=q)\]?\s*(?:(?::\s*&?[\w.<>\[\]]+\s*(?==\s*["'`]))?(?::=|=>|=)|:|,(?=\s*["'`]))\s*(?P<value>"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?|`[^`\n]*`?|[^\s"'`#;,<>{}()\[\]][^\s"'`;,<>]*)?"""
)
_TAG = re.compile(r"<(?P<key>[A-Za-z_][\w.\-\xb1]*)>(?P<value>[^<\n]+)</(?P=key)>")
_PROPERTY = re.compile(r"""\b(?:name|key|id)\s*=\s*["'](?P<key>[^"'\n]+)["'](?:(?!\b(?:name|key|id)\s*=)[^<>\n])*?\bvalue\s*=\s*(?P<value>"[^"\n]*"|'[^'\n]*')""")
_NAMED = re.compile(r"""^[\s\-{"']*(?:name|key)["']?\s*[:=]\s*["']?(?P<key>[A-Za-z_][\w.\-\xb1]*)["']?,?\s*$""")
_OPENED = re.compile(r"""(?P<q>["']?)""" + _STARTS + r"""(?P<key>[A-Za-z_][\w.\-\xb1]*)(?P=q)\]?\s*(?::\s*&?[\w.]+\s*)?(?::=|=|:)\s*(?:[|>][+\-]?\d?|\"\"\"|'''|`|\(|\\|["'])?\s*$""")

_NAME = re.compile(r"[A-Za-z_][\w.\-\xb1\xc3]*")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_HOLDER = re.compile(
    r"(?i)^(?:$|x{3,}|\*+|\.{3,}|_+|-+|0+|1234\w*|n/?a|nil|null|none|true|false|yes|no|on|off|undefined|empty|changeme|change[_\-]?(?:me|it)|replace[_\-]?(?:me|this)?|todo|tbd|fixme|dummy|fake|sample|example|test(?:ing)?|placeholder|redacted|removed|hidden|masked|secret|password|passwd|token|default|foo(?:bar)?|bar|string|insert.*|your[_\-].*|my[_\-].*|enter[_\-].*|put[_\-].*)$"
    r"|example|sample|placeholder|redacted|changeme|replace.?me|dummy|your[_\-]|x{6,}|\*{3,}|\.{4,}|insert[_\-]"
)
_LOOKUP = re.compile(
    r"(?i)^(?:[$%@&<{\[(]|env[:.]|vault[:.]|ssm:|arn:|op://|sops:|kms:|file:|secrets?[./:]|aws-?sm:|gcp-?sm:|keyring:|keychain:|ref[:+]|enc\[|!|process\.env|os\.|system\.|viper\.|config[.\[]|settings[.\[]|self\.|this\.)|\$\{|\$\(|\{\{|%\(|%[sdv]\b|\$[A-Z_]{2,}|getenv|environ|^#\{"
)
_SETTING_VALUE = re.compile(
    r"^(?:[\d.,:+\-]+(?:ms|[smhdwKMG]i?[bB]?)?|[~.]?/?(?:[a-z0-9_.\-~]+/)+[a-z0-9_.\-]*|~?/[a-z0-9_./\-]*|[A-Za-z]:\\.*|[a-z][\w+.\-]*://[^@]*|[a-z0-9\-]+(?:\.[a-z0-9\-]+)*\.(?:invalid|local|com|net|org|io|dev|internal|test|localhost)(?::\d+)?|[a-z]+(?:[_\-. ][a-z]+)*|[A-Z]+(?:[_\- ][A-Z]+)*|[A-Z]?[a-z]+(?:[\- ][A-Z]?[a-z]+)*|(?:[a-zA-Z_]\w*\.)+[a-zA-Z_]\w*|[a-zA-Z_]\w*\(.*)$"
)
_UUID = re.compile(r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$")



def _least(marks: list[str]) -> tuple[str, ...]:
    """The marks that contain no other one."""
    return tuple(m for m in dict.fromkeys(marks) if not any(o != m and o in m for o in marks))


#: One of these is in every line that a pattern or a key can accept; looked for in the chunk, then in
#: its lines, before any of the patterns. The first are compared in lower case, the others as they are.
_FOLDED = _least(
    [w.encode().decode("latin-1").lower() for w in _SECRET_WORDS]
    + ["key", "token", "cred", "login", "log-in", "passw", "://", "authorization", "basic", "bearer", "-u", *_PARTS, *_COMMANDS]
)
_EXACT = _least(["AKIA", "ASIA", "eyJ"] + " ".join(_TOKENS.values()).split())


#: A line of code without any quote, comment or URL has no literal text, unless it is in one over lines.
_PLAIN_CODE = re.compile(r"[^\"'`#/]*$")


#: Literals that may go over lines, after the comments and one-line strings they must not begin in.
_QUOTED = r""""(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'"""
_SKIP = r"/\*.*?(?:\*/|\Z)|//[^\n]*|" + _QUOTED
_RAW = r"`(?P<raw>[^`]*)(?:`|\Z)"
_TEMPLATE = r"`(?P<raw>(?:[^`\\]|\\.)*)(?:`|\Z)"
_TRIPLE = r'"""(?P<three>(?:[^\\"]|\\.|"(?!""))*)(?:"""|\Z)'
_HASHED = r"#[^\n]*|" + _QUOTED
_MULTI = (
    {
        "go": re.compile(_RAW + "|" + _SKIP, re.S),
        "py": re.compile(_TRIPLE + r"|'''(?P<raw>(?:[^\\']|\\.|'(?!''))*)(?:'''|\Z)|#[^\n]*|" + _QUOTED, re.S),
        "rs": re.compile(r'/\*.*?(?:\*/|\Z)|//[^\n]*|\'(?:[^\'\\\n]|\\.)\'|r(?P<mark>#*)"(?P<raw>.*?)(?:"(?P=mark)|\Z)|"(?P<three>(?:[^"\\]|\\.)*)(?:"|\Z)', re.S),
        "rb": re.compile(r"<<[~\-]?[\"'`]?(?P<mark>[A-Z_][A-Z0-9_]*)[\"'`]?[^\n]*\n(?P<raw>.*?)(?:\n[ \t]*(?P=mark)\b|\Z)|" + _HASHED, re.S),
        "php": re.compile(r"<<<[ \t]*[\"']?(?P<mark>[A-Za-z_]\w*)[\"']?[ \t\r]*\n(?P<raw>.*?)(?:\n[ \t]*(?P=mark)\b|\Z)|" + _SKIP + "|#[^\n]*", re.S),
    }
    | dict.fromkeys(("cc", "cpp", "hpp", "h"), re.compile(r'R"(?P<mark>[^()\s\\"]{0,16})\((?P<raw>.*?)(?:\)(?P=mark)"|\Z)|' + _SKIP, re.S))
    | dict.fromkeys(("ts", "tsx", "js", "jsx"), re.compile(_TEMPLATE + "|" + _SKIP, re.S))
    | dict.fromkeys(("java", "kt", "scala", "swift", "cs"), re.compile(_TRIPLE + "|" + _SKIP, re.S))
)


def _inner(text: str, extension: str) -> Iterator[tuple[int, int]]:
    """Ranges of the literals of a source text that go over lines; one that is cut off ends with the text."""
    pattern = _MULTI.get(extension)
    if pattern is None:
        return
    for m in pattern.finditer(text):
        if m.lastgroup and "\n" in m[0]:
            yield m.span(m.lastgroup)


#: Fenced blocks of prose, with the format they are said to be in.
_FENCED = re.compile(r"(?ms)^[ \t>]*(?:```+|~~~+)[ \t]*(?P<form>\w*)[^\n]*\n(?P<body>.*?)(?:^[ \t>]*(?:```|~~~)|\Z)")
_DOCS = {"md", "markdown", "rst", "adoc", "txt"}


def _embedded(text: str, extension: str, inner: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, format) of configuration inside other text: literals over lines and fenced blocks."""
    for start, end in inner:
        if form := sniff(text[start:end]):
            yield start, end, form
    if extension in _DOCS and ("```" in text or "~~~" in text):
        for m in _FENCED.finditer(text):
            if form := FORMATS.get(m["form"].lower()) or (None if m["form"] else sniff(m["body"])):
                yield *m.span("body"), form


class Finding(NamedTuple):
    """A credential: byte range of its value, line (from 1), what it is, and the key path."""

    start: int
    end: int
    line: int
    kind: str
    key: str


def key_strength(key: str) -> int:
    """2 if a key names a secret, 1 if it may (a token or key of some kind), 0 otherwise.

    Words are told apart by case, digits and separators; settings of secrets (their names, files,
    lengths, life times) are none.
    """
    words = [w.lower() for w in _WORDS.findall(key.replace("\u00c3\u00b1", "n").replace("ñ", "n"))]  # also as two bytes
    if not words or words[-1] in _SETTING or "public" in words:
        return 0
    joined = "".join(words)
    if "access" in words and "key" in words and words[-1] == "key":
        return 2
    for n, w in enumerate(words):
        before = words[n - 1] if n else ""
        if w in _SECRET_WORDS and (w != "pass" or n == len(words) - 1):
            return 2
        if (w == "key" and before in _KEY_OF) or (w == "token" and before in _TOKEN_OF):
            return 2
    if joined.endswith(("apikey", "secretkey", "authtoken", "accesstoken", "passwd", "password")):
        return 2
    return 1 if words[-1] in ("token", "key", "tokens", "keys") and len(words) <= 2 else 0


#: Names that say nothing about their value; the key above them does.
_GENERIC = {"value", "val", "default", "defaultvalue", "data", "plain", "plaintext", "literal", "raw", "content", "text", "current", "string"}


def path_strength(path: tuple[str, ...]) -> int:
    """``key_strength`` of the last telling key of a path; items of lists and generic names tell
    nothing. A secret named by two keys together (``api``, ``key``) gives 1."""
    keys = [re.sub(r"#\d+$", "", k) for k in path]
    while len(keys) > 1 and (keys[-1].isdigit() or keys[-1].lower() in _GENERIC):
        keys.pop()
    own = key_strength(keys[-1]) if keys else 0
    if own < 2 and len(keys) > 1 and key_strength(f"{keys[-2]}_{keys[-1]}") == 2:
        return 1
    return own


def _decoded(value: str) -> str:
    """Printable text behind base64, else an empty string."""
    if len(value) < 12 or len(value) % 4 or not re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", value):
        return ""
    try:
        text = base64.b64decode(value, validate=True).decode("ascii")
    except (binascii.Error, UnicodeDecodeError):
        return ""
    return text if text.strip("\r\n").isprintable() else ""


def literal(value: str, least: int = 6) -> bool:
    """Whether a value can be a secret as it stands: no placeholder, look-up, setting or plain words."""
    if len(value) < least or _HOLDER.search(value) or _LOOKUP.search(value) or _SETTING_VALUE.match(value) or _UUID.match(value):
        return False
    inner = _decoded(value)
    if inner and (_HOLDER.search(inner.strip()) or _LOOKUP.search(inner.strip())):
        return False
    if " " in value and not re.search(r"\d", value):
        return False
    return len(set(value)) >= 5


def random_like(value: str, least: int = 16) -> bool:
    """Whether a value looks generated: long, with digits among letters, many different characters."""
    return (
        len(value) >= least
        and re.fullmatch(r"[\w+/=.~\-]+", value) is not None
        and re.search(r"\d", value) is not None
        and re.search(r"[A-Za-z]", value) is not None
        and len(set(value)) >= min(10, len(value) // 2)
        and literal(value)
    )


def password_like(value: str) -> bool:
    """Letters with a digit, and a capital or a sign among them."""
    return len(value) >= 8 and re.search(r"\d", value) is not None and re.search(r"[A-Za-z]{2}", value) is not None and re.search(r"[A-Z!#$%&*+?@^~_\-]", value) is not None and literal(value)


def short_password(value: str) -> bool:
    """At least six characters with letters and a digit, where a password is expected."""
    return len(value) >= 6 and re.search(r"\d", value) is not None and re.search(r"[A-Za-z]{2}", value) is not None and literal(value)


def mixed_case(value: str) -> bool:
    """A long run of letters whose case changes often, as in encoded text without digits."""
    return len(value) >= 12 and re.fullmatch(r"[\w+/=\-]+", value) is not None and len(re.findall(r"[a-z][A-Z]|[A-Z]{2}[a-z]", value)) >= 4 and literal(value)


def _unquoted(match: re.Match, text: str) -> tuple[int, int, bool]:
    """Byte range of the bare value of an entry, and whether it was quoted."""
    start, end = match.span("value")
    if start < 0:
        return 0, 0, False
    if text[start] in "\"'`":
        closed = end - start > 1 and text[end - 1] == text[start]
        return start + 1, end - closed, True
    return start, end, False


_BARE = re.compile(r"(\S*?)[,;]?(?:[ \t\r]*$|\s+#)")


def _entries(line: str, offset: int, source: bool, named: str) -> Iterator[tuple[str, int, int]]:
    """(key, start, end) of the entries of a line; ``named`` is the name a preceding line gave."""
    for m in _TAG.finditer(line):
        yield m["key"], offset + m.start("value"), offset + m.end("value")
    for m in _PROPERTY.finditer(line):
        yield m["key"], offset + m.start("value") + 1, offset + m.end("value") - 1
    at = 0
    while m := _ENTRY.search(line, at):
        start, end, quoted = _unquoted(m, line)
        at = max(m.end("key") + 1, start if start and not quoted else end)
        if end <= start or (source and not quoted):
            continue
        if not quoted:
            # a bare value reaches to the end of the line or to a comment
            rest = _BARE.match(line, start)
            end = max(end, rest.end(1)) if rest else end
        key = named if m["key"].lower() == "value" and named else m["key"]
        yield key, offset + start, offset + end


#: Extensions of code, where only quoted text is a literal.
_SOURCE = {"go", "py", "ts", "tsx", "js", "jsx", "java", "rs", "c", "h", "cc", "cpp", "hpp", "cs", "rb", "php", "kt", "scala", "swift"}


def _body_end(text: str, at: int) -> int:
    """The end of the lines of key material from ``at`` on, for blocks without an END line."""
    end, short = at, False
    if len((one := _ESCAPED.match(text, at))[0]) >= 24:
        return one.end()
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        line = text[at:stop]
        core = _DRESS.sub("", line)
        if core and not _PEM_HEADER.match(core):
            if short or not _MATERIAL.fullmatch(core):
                break
            # the last line may be short, but is no word
            short = len(core) < 24
            if short and not (core.endswith("=") or re.search(r"[\d+/]", core)):
                break
            end = at + len(line.rstrip())
        at = stop + 1
    return end


def _blocks(text: str) -> Iterator[tuple[int, int, int]]:
    """(begin line start, body start, body end) of private key blocks that have a body.

    A block without END line ends with its last line of key material, however long it is.
    """
    begins, stops, at = list(_BEGIN.finditer(text)), [m.start() for m in _END.finditer(text)], 0
    for n, m in enumerate(begins):
        if m.start() < at:
            continue
        limit = begins[n + 1].start() if n + 1 < len(begins) else len(text)
        place = bisect_left(stops, m.end())
        end = stops[place] if place < len(stops) and stops[place] <= limit else min(limit, _body_end(text, m.end()))
        body = text[m.end() : end]
        if any(len(set(x)) > 4 for x in _BODY.findall(body)) or (not body.strip() and m.end() >= len(text.rstrip())):
            yield m.start(), m.end(), end
        at = max(end, m.end())


def _credential_pair(m: re.Match) -> bool:
    value = m[2]
    return (short_password(value) and re.search(r"[A-Z!#$%&*+?@^~_\-]", value) is not None) if _ACCOUNT.fullmatch(m[1]) else password_like(value) and random_like(value)


def find_credentials(content: str | None, path: str | None = None) -> list[Finding]:
    """All credentials of a text, in order; null and empty texts have none."""
    if not content:
        return []
    text = content.encode("utf-8", "surrogatepass").decode("latin-1")  # one character per byte
    low = text.lower()
    folded, exact = [m for m in _FOLDED if m in low], [m for m in _EXACT if m in text]
    pairs = [m for m in _PAIR.finditer(text) if _credential_pair(m)]
    if not folded and not exact and not pairs:
        return []
    found: list[Finding] = []
    taken = bytearray(len(text))
    breaks = [m.start() for m in re.finditer("\n", text)]

    def add(start: int, end: int, kind: str, key: str) -> None:
        if end > start and not any(taken[start:end]):
            taken[start:end] = b"\1" * (end - start)
            found.append(Finding(start, end, bisect_left(breaks, start) + 1, kind, key))

    if "PRIVATE KEY" in text:
        for begin, start, end in _blocks(text):
            taken[begin:end] = b"\1" * (end - begin)
            found.append(Finding(start, end, bisect_left(breaks, begin) + 1, "private key", ""))
    for m in pairs:
        add(m.start(2), m.end(2), "credential in text", "")
    form = format_of(path)
    if form:
        _configuration(text, low, form, folded, exact, add)
    else:
        _lines(text, low, (path or "").rsplit(".", 1)[-1].lower(), folded, exact, add)
    found.sort()
    return found


def _configuration(text: str, low: str, form: str, folded: list[str], exact: list[str], add) -> None:
    """Credentials of a text in one of the formats: by key path, and by what values look like."""

    def marked(start: int, end: int) -> bool:
        return any(low.find(m, start, end) >= 0 for m in folded) or any(text.find(m, start, end) >= 0 for m in exact)

    offset = 0
    for line in text.split("\n"):
        if len(line) > 3 and marked(offset, offset + len(line)):
            _shapes(line, offset, add)
        offset += len(line) + 1
    parsed = entries(text, form)
    named = _names(text, parsed)
    inside: list[tuple[int, int]] = []
    for number, e in enumerate(parsed):
        if isinstance(e, Rest):
            inside.append((e.start, e.end))
            continue
        path = e.path[:-1] + (named[number],) if number in named else e.path
        strength = path_strength(path)
        lines = [x.strip().rstrip("\\") for x in text[e.start : e.end].split("\n") if x.strip()]
        value = "".join(lines)
        if strength == 2 and len(lines) > 1:
            if " " not in value and (password_like(value) or random_like(value) or mixed_case(value)):
                add(e.start, e.end, "multi-line value", ".".join(path))
        elif strength and _secret(value, strength):
            add(e.start, e.end, "secret value", ".".join(path))
        if len(value) > 3 and ("=" in value or ":" in value or "," in value or " " in value):
            inside.append((e.start, e.end))
    # comments, and strings that hold text of their own
    for start, end in inside:
        for line in text[start:end].split("\n"):
            if marked(start, start + len(line)):
                _keyed(text, line, start, False, "", add)
                _prose(line, start, add)
            start += len(line) + 1


def _names(text: str, parsed: list) -> dict[int, str]:
    """For entries that are the value of a name beside them: their number and that name."""
    last: dict[tuple[str, ...], str] = {}
    waiting: dict[tuple[str, ...], int] = {}
    named: dict[int, str] = {}
    for number, e in enumerate(parsed):
        if isinstance(e, Rest) or not e.path:
            continue
        leaf = e.path[-1].lower()
        if leaf in ("name", "key", "id", "variable") and _NAME.fullmatch(text[e.start : e.end]):
            last[e.path[:-1]] = text[e.start : e.end]
            if e.path[:-1] in waiting:
                named[waiting.pop(e.path[:-1])] = text[e.start : e.end]
        elif leaf in ("value", "val"):
            if e.path[:-1] in last:
                named[number] = last.pop(e.path[:-1])
            else:
                waiting[e.path[:-1]] = number
        elif e.path in last:  # the text of an element that has a name
            named[number] = last.pop(e.path)
    return named


def _lines(text: str, low: str, extension: str, folded: list[str], exact: list[str], add) -> None:
    """Credentials of source code, scripts and prose, line by line."""
    source = extension in _SOURCE
    inner = list(_inner(text, extension)) if source else []
    for start, end, form in _embedded(text, extension, inner):
        shifted = lambda a, b, kind, key, start=start: add(start + a, start + b, kind, key)
        _configuration(text[start:end], low[start:end], form, folded, exact, shifted)
    offset, named, opened = 0, "", ""
    for line, lower in zip(text.split("\n"), low.split("\n"), strict=True):
        bare = line.strip()
        expected = opened or (named and key_strength(named))
        if opened and bare:
            value = bare.strip("\"'`,;+ \\")
            if " " not in value and (password_like(value) or random_like(value) or mixed_case(value)) and not _ENTRY.match(bare):
                at = offset + line.index(value)
                add(at, at + len(value), "multi-line value", opened)
            opened = ""
        marked = len(line) > 3 and (expected or any(m in lower for m in folded) or any(m in line for m in exact))
        while inner and inner[0][1] <= offset:
            inner.pop(0)
        if marked and inner and inner[0][0] < offset + len(line):
            # the part of the line in a literal is read as configuration
            start, end = max(inner[0][0], offset), min(inner[0][1], offset + len(line))
            _line(text, text[start:end], start, False, named, add)
        if marked and source and _PLAIN_CODE.match(line):
            _tokens(line, offset, add)
        elif marked:
            _line(text, line, offset, source, named, add)
            if (m := _OPENED.search(line)) and key_strength(m["key"]) == 2:
                opened = m["key"]
        if bare:
            m = _NAMED.match(line)
            named = m["key"] if m else ""
        offset += len(line) + 1


def _tokens(line: str, offset: int, add) -> None:
    for pattern, kind in ((_PROVIDER, "provider token"), (_SIGNED, "signed token"), (_ACCESS_ID, "access key id")):
        for m in pattern.finditer(line):
            if not _HOLDER.search(m[0]) and len(set(m[0])) >= 8:
                add(offset + m.start(), offset + m.end(), kind, "")


def _line(text: str, line: str, offset: int, source: bool, named: str, add) -> None:
    _shapes(line, offset, add)
    _keyed(text, line, offset, source, named, add)
    _prose(line, offset, add)


def _shapes(line: str, offset: int, add) -> None:
    """Credentials that are told by what they and their surroundings look like."""
    _tokens(line, offset, add)
    for m in _URL.finditer(line):
        # a password ends at the last @ before the host
        if not _HOLDER.search(m[2]) and not _LOOKUP.search(m[2]) and not re.fullmatch(r"(?i)pass(word)?|pw|pwd|secret|%\w", m[2]) and len(m[2]) >= 4:
            add(offset + m.start(2), offset + m.end(2), "password in URL", "")
    for m in _CONNECTION.finditer(line):
        if line.count(";") and literal(m[1]):
            add(offset + m.start(1), offset + m.end(1), "connection string", "")
    for pattern in (_HEADER, _SCHEME):
        for m in pattern.finditer(line):
            scheme, value = (m[1] or "").lower(), m[2]
            inner = _decoded(value)
            if scheme == "basic":
                good = ":" in inner and not _HOLDER.search(inner.split(":", 1)[1]) and not _LOOKUP.search(inner.split(":", 1)[1])
            else:
                good = random_like(value) and (bool(scheme) or pattern is _HEADER)
            if good and (pattern is _HEADER or scheme == "basic" or re.search(r"(?i)auth|header|curl|bearer", line)):
                add(offset + m.start(2), offset + m.end(2), "authorization", "")
    for m in _OPTION.finditer(line):
        if short_password(m[1]) or random_like(m[1], 12):
            add(offset + m.start(1), offset + m.end(1), "command option", "")
    for run in _RUN.finditer(line):
        for m in _SHORT.finditer(line, *run.span(1)):
            if literal(m[1]) and re.search(r"\d", m[1]) and re.search("[A-Za-z]", m[1]):
                add(offset + m.start(1), offset + m.end(1), "command option", "")
    for run in _FETCH.finditer(line):
        for m in _USER_OPTION.finditer(line, *run.span(1)):
            if literal(m[2]):
                add(offset + m.start(2), offset + m.end(2), "command option", "")


def _secret(value: str, strength: int) -> bool:
    """Whether the value of a key that names a secret (2) or may name one (1) is a credential."""
    if value.startswith("-----BEGIN") or "://" in value:
        return False
    if strength == 1:
        good = random_like(value)
    else:
        good = literal(value) and (re.search(r"\d", value) is not None or mixed_case(value) or (re.search(r"[^\w\s]", value) is not None and re.search(r"[A-Z]", value) is not None))
    return good and not (" " in value and not password_like(value))


def _keyed(text: str, line: str, offset: int, source: bool, named: str, add) -> None:
    """Credentials in what a line assigns to keys."""
    for key, start, end in _entries(line, offset, source, named):
        strength = key_strength(key)
        if strength and _secret(text[start:end].strip(), strength):
            add(start, end, "secret value", key)


def _prose(line: str, offset: int, add) -> None:
    for m in _PROSE.finditer(line):
        if password_like(m[1]) and not _SIGNED.search(m[1]) and "://" not in m[1]:
            add(offset + m.start(1), offset + m.end(1), "credential in text", "")


_KEPT = re.compile(rb"[\r\n]+[ \t]*")


def redact(content: str, findings: list[Finding]) -> str:
    """The text with every byte of a credential replaced by a letter; line breaks inside it and the
    blanks that indent its lines are kept, so lines, columns and formats stay as they are."""
    data = bytearray(content.encode("utf-8", "surrogatepass"))
    for f in findings:
        at = f.start
        for kept in [*_KEPT.finditer(data, f.start, f.end), None]:
            end = kept.start() if kept else f.end
            data[at:end] = b"x" * (end - at)
            at = kept.end() if kept else end
    return data.decode("utf-8", "surrogatepass")


def credentials(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content", path_col: str = "path") -> DataFrame:
    """``id, line_no, kind, key, start_byte, end_byte, redacted``: one row per credential.

    ``redacted`` is the whole content without any of its credentials, on the first row of each
    chunk and null on its others. Null and empty contents give no rows; equal chunks report each;
    null paths are treated as configuration, rows without an id cannot be reported and are left out. One map over the chunks, nothing is shuffled.
    """
    kind = chunks.schema[id_col].dataType.simpleString()

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text, path in zip(batch[id_col].tolist(), batch[text_col].tolist(), batch[path_col].tolist(), strict=True):
                found = find_credentials(text, path)
                clean = redact(text, found) if found else None
                rows += [(key, f.line, f.kind, f.key, f.start, f.end, None if n else clean) for n, f in enumerate(found)]
            yield pd.DataFrame(rows, columns=[id_col, "line_no", "kind", "key", "start_byte", "end_byte", "redacted"])

    return spread(chunks.select(id_col, text_col, path_col).filter(F.col(id_col).isNotNull())).mapInPandas(find, f"{id_col} {kind}, line_no int, kind string, key string, start_byte int, end_byte int, redacted string")
