"""Qualified names: segments, suffixes, mangled symbols and pointer-like types."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

FILE_PREFIX = "FILE_"


def split_name(pretty: str, sym: str = "") -> tuple[list[str], str]:
    """The segments of a name and what joins them.

    A file's segments keep their slash.  Other names split on ``::`` outside template arguments; within arguments ``<<``
    is a shift and opens nothing.  A single colon outside arguments turns into ``)``, as stored data has it.
    """
    if sym.startswith(FILE_PREFIX):
        return re.findall(r"[^/]*/|[^/]+", pretty), ""
    pieces, token, depth, i = [], [], 0, 0
    while i < len(pretty):
        c = pretty[i]
        if depth:
            token.append(c)
            if c == "<" and i + 1 < len(pretty):
                i += 1  # the next character is taken as it is; a second "<" makes both a shift
                token.append(pretty[i])
                depth += pretty[i] != "<"
            elif c == ">":
                depth -= 1
        elif c == ":" and i + 1 < len(pretty):
            i += 1
            if pretty[i] == ":":
                pieces.append("".join(token))
                token = []
            else:
                token += [")", pretty[i]]
        elif c != ":":
            token.append(c)
            depth += c == "<"
        i += 1
    if token:
        pieces.append("".join(token))
    return pieces, "::"


@F.pandas_udf(ArrayType(StringType()))
def name_segments(pretty: pd.Series, sym: pd.Series) -> pd.Series:
    """Segments of names that hold template arguments or single colons; plain names split natively in ``segments``."""
    return pd.Series([split_name(p or "", s or "")[0] for p, s in zip(pretty, sym, strict=True)])


def segments(pretty: Column, sym: Column, udf: bool = True) -> Column:
    """Segments of a name.  Without ``<`` or a lone colon a native split is exact; ``udf`` covers the rest."""
    files = F.filter(F.regexp_extract_all(pretty, F.lit("([^/]*/|[^/]+)"), F.lit(1)), lambda s: s != "")
    plain = F.split(pretty, "::")
    plain = F.when(F.element_at(plain, -1) == "", F.slice(plain, 1, F.size(plain) - 1)).otherwise(plain)
    plain = F.when(pretty == "", F.array().cast("array<string>")).otherwise(plain)
    odd = pretty.rlike("<|(^|[^:]):($|[^:])|:::")
    return F.when(sym.startswith(FILE_PREFIX), files).when(odd, name_segments(pretty, sym)).otherwise(plain) if udf else F.when(sym.startswith(FILE_PREFIX), files).otherwise(plain)


def suffixes(parts: Column, joiner: Column | str) -> Column:
    """Every run of segments up to the last one, joined, without empty ones."""
    n = F.size(parts)
    every = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), joiner)) if isinstance(joiner, str) else F.transform(F.sequence(F.lit(1), n), lambda i: F.concat_ws("", F.slice(parts, i, n)))
    return F.when(n > 0, F.filter(every, lambda s: s != "")).otherwise(F.array().cast("array<string>"))


def mangled(parts: list[str]) -> str:
    """The Itanium nested name of segments, without parameters."""
    return "_ZN" + "".join(f"{len(p)}{p}" for p in parts) + "E"


def is_callable(kind: Column) -> Column:
    return kind.isin("function", "method", "file")


def is_class(kind: Column) -> Column:
    return kind.isin("class", "struct")


def is_lambda(pretty: Column) -> Column:
    return pretty.rlike(r"\(lambda\d+\)$")


def is_namespace(sym: Column) -> Column:
    return sym.startswith("NS_")


# ---------------------------------------------------------------- types


@dataclass
class TypeRules:
    """How templates and classes are read: name -> (rule, pointer kind or labels, argument)."""

    pointers: dict[str, tuple[str, int]] = field(default_factory=dict)  # name -> (kind, which argument)
    decorators: dict[str, list[str]] = field(default_factory=dict)  # name -> labels
    containers: set[str] = field(default_factory=set)
    variants: set[str] = field(default_factory=set)
    values: set[str] = field(default_factory=set)
    nothing: set[str] = field(default_factory=set)


@dataclass
class _Type:
    name: str
    tagged: bool
    sign: str  # "*", "&" or ""
    args: list[_Type]
    bail: bool = False


def _arguments(text: str) -> list[str]:
    out, depth, at, i = [], 0, 0, 0
    while i < len(text):
        if text.startswith("<<", i) or text.startswith(">>", i) and not depth:
            i += 2
            continue
        c = text[i]
        depth += (c in "<([") - (c in ">)]")
        if c == "," and not depth:
            out.append(text[at:i])
            at = i + 1
        i += 1
    return [a.strip() for a in [*out, text[at:]] if a.strip()]


def _read_type(text: str) -> _Type:
    text = text.strip()
    tagged = False
    while m := re.match(r"(const|volatile|class|struct|union|enum)\s+", text):
        if m[1] in ("union", "enum"):
            return _Type("", False, "", [], True)
        tagged |= m[1] in ("class", "struct")
        text = text[m.end() :]
    sign = ""
    while m := re.search(r"\s*(\*|&|const|volatile)$", text):
        if m[1] in "*&" or m.start() != m.end() - len(m[1]):
            sign = m[1] if m[1] in "*&" else sign
            text = text[: m.start()]
        else:
            break
    if not text or text[0].isdigit():
        return _Type("", False, "", [], True)
    at = text.find("<")
    if at < 0 or not text.rstrip().endswith(">"):
        return _Type(text, tagged, sign, [])
    inner = text.rstrip()[at + 1 : -1]
    return _Type(text[:at].strip(), tagged, sign, [_read_type(a) for a in _arguments(inner)])


def pointees(text: str, rules: TypeRules) -> tuple[list[tuple[str, str]], list[str]]:
    """(pointer kind, class name) of what a field of this type holds or points to, and labels that the type brings."""
    labels: list[str] = []
    held: set[int] = set()  # types whose argument a pointer rule has taken

    def held_by(t: _Type) -> list[tuple[str, str]]:
        """What a type that stands as an argument is to its container."""
        if t.bail or id(t) in held or t.name in rules.nothing:
            return []
        if t.sign:
            return [("raw" if t.sign == "*" else "ref", t.name)]
        return [("contains", t.name)] if t.tagged and t.name not in rules.values else []

    def visit(t: _Type) -> list[tuple[str, str]]:
        """Of nested templates first, then of the template's own arguments if its rule says so."""
        found = [p for a in t.args if a.args for p in visit(a)]
        if t.name in rules.pointers:
            kind, which = rules.pointers[t.name]
            if which < len(t.args):
                held.add(id(t))
                arg = t.args[which]
                found += [(kind, arg.name)] if arg.tagged and arg.name not in rules.values else []
        elif t.name in rules.decorators or t.name in rules.containers | rules.variants:
            labels.extend(rules.decorators.get(t.name, []))
            found += [p for a in t.args for p in held_by(a)]
        return found

    whole = _read_type(text)
    if whole.bail:
        return [], []
    found = visit(whole)
    return found or held_by(whole), labels
