"""Paths: globs, directory names, mangling, natural order, kinds and tags."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

_ESCAPED = set("()|.")


def glob_to_regex(glob: str) -> str:
    """``*`` stays within a directory, ``**`` crosses them, ``?`` is one character, ``{a,b}`` alternates; ``^ $`` stay."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i):
            out.append(".*")
            i += 1
        elif c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append(".")
        elif c == "{":
            depth += 1
            out.append("(")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append("\\" + c if c in _ESCAPED else c)
        i += 1
    return "".join(out)


def escape_regex(text: str) -> str:
    """The text as a pattern that finds itself."""
    return re.sub(r"([\\.+*?()|\[\]{}^$#&\-~])", r"\\\1", text)


def dirname(path: Column) -> Column:
    """The path's directory, without a slash at the end; empty for a bare name."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def mangle(path: Column) -> Column:
    """Every character but letters, digits, ``_`` and ``/`` becomes ``@`` and its first byte in hexadecimal."""
    safe = F.lit(r"^[A-Za-z0-9_/]$")
    coded = lambda c: F.when(F.regexp_like(c, safe), c).otherwise(F.concat(F.lit("@"), F.substring(F.hex(F.encode(c, "UTF-8")), 1, 2)))
    return F.array_join(F.transform(F.split(path, ""), coded), "")


def unmangle(path: Column) -> Column:
    """Every ``@XX`` as the character of that number."""
    parts = F.split(path, "@(?=[0-9A-F]{2})")
    read = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.concat(F.char(F.conv(F.substring(p, 1, 2), 16, 10).cast("int")), F.substring(p, F.lit(3), F.char_length(p))))
    return F.concat(F.get(parts, F.lit(0)), F.array_join(read, ""))


def natural_key(path: Column) -> Column:
    """A string whose byte order is natural order: lower case, and numbers by size, whatever their length.

    A run of digits goes without leading zeros behind its length: one character for up to eight digits, else more.
    """
    pieces = F.regexp_extract_all(F.lower(path), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def sized(digits: Column) -> Column:
        n = F.char_length(digits)
        return F.concat(F.repeat(F.lit("9"), F.floor(n / 9).cast("int")), (n % 9).cast("string"), digits)

    bare = lambda p: F.coalesce(F.nullif(F.regexp_replace(p, "^0+", ""), F.lit("")), F.lit("0"))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^[0-9]"), sized(bare(p))).otherwise(p)), "")


def valid_path(path: str) -> str:
    """The path without leading slashes; one that climbs with ``..`` is refused."""
    if ".." in path.split("/"):
        raise ValueError(f"path {path!r} leaves the tree")
    return path.lstrip("/")


@dataclass
class PathKind:
    """A kind of files and the signs that decide for it."""

    name: str
    decision_order: int
    sort_order: int = 0
    dir_names: list[str] = field(default_factory=list)
    dir_prefixes: list[str] = field(default_factory=list)
    dir_suffixes: list[str] = field(default_factory=list)
    path_prefixes: list[str] = field(default_factory=list)


def path_kind(path: Column, kinds: list[PathKind]) -> Column:
    """The first kind in decision order that has a sign in the path; the kind decided first is what is left otherwise."""
    dirs = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    ordered = sorted(kinds, key=lambda k: k.decision_order)
    out = F.lit(None).cast("string")
    for kind in reversed(ordered):
        signs = [path.startswith(p) for p in kind.path_prefixes]
        if kind.dir_names:
            signs.append(F.arrays_overlap(dirs, F.array(*map(F.lit, kind.dir_names))))
        signs += [F.exists(dirs, _starts(p)) for p in kind.dir_prefixes] + [F.exists(dirs, _ends(p)) for p in kind.dir_suffixes]
        for sign in signs:
            out = F.when(sign, F.lit(kind.name)).otherwise(out)
    # Set signs in decision order: the loop above runs backwards, so the earliest kind's test is the outermost.
    return F.coalesce(out, F.lit(ordered[0].name))


def _starts(prefix: str):
    return lambda d: d.startswith(prefix)


def _ends(suffix: str):
    return lambda d: d.endswith(suffix)


def ignore_rules(lines: list[str]) -> list[tuple[str, bool]]:
    """(regex, adds) of the lines of a glob list: ``#`` comments, ``!`` negates, ``\\`` escapes, a final ``/`` takes all below."""
    out = []
    for line in lines:
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        adds = not line.startswith("!")
        line = line if adds else line[1:]
        line = line[1:] if line.startswith("\\") else line
        line = f"{line}**" if line.endswith("/") else line
        out.append((f"^{glob_to_regex(line.lstrip('/'))}$", adds))
    return out


def last_match(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether the last rule that fits the path adds it; without a fit it is not added."""
    out = F.lit(False)
    for regex, adds in rules:
        out = F.when(path.rlike(regex), F.lit(adds)).otherwise(out)
    return out
