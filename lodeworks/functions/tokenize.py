"""Source tokenizers, by language family, and an outline by patterns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Token:
    start: int
    text: str
    kind: str


_C_LIKE = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<raw>R"(?P<tag>[^()\\\s]{0,16})\(.*?\)(?P=tag)")|(?P<template>`(?:\\.|[^`\\])*`?)"""
    r"""|(?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<prep>^[ \t]*\#[^\n]*)|(?P<number>\d[\w.']*)|(?P<word>[^\W\d]\w*)|(?P<newline>\n)|(?P<space>[^\S\n]+)|(?P<mark>.)""",
    re.S | re.M | re.X,
)
_HASH = re.compile(
    r"""(?P<comment>\#[^\n]*)|(?P<string>'''.*?(?:'''|\Z)|\"\"\".*?(?:\"\"\"|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<number>\d[\w.]*)|(?P<word>[^\W\d]\w*)|(?P<newline>\n)|(?P<space>[^\S\n]+)|(?P<mark>.)""",
    re.S | re.X,
)
_CSS = re.compile(r"""(?P<comment>/\*.*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<at>@[\w-]+)|(?P<word>-{0,2}[^\W\d][\w-]*)|(?P<number>\d[\w.%]*)|(?P<newline>\n)|(?P<space>[^\S\n]+)|(?P<mark>.)""", re.S | re.X)
_TAGS = re.compile(r"""(?P<comment><!--.*?(?:-->|\Z))|(?P<tag></?[A-Za-z][\w:-]*|/?>)|(?P<string>"[^"]*"|'[^']*')|(?P<word>[^\W\d][\w:-]*)|(?P<newline>\n)|(?P<space>[^\S\n]+)|(?P<mark>.)""", re.S | re.X)
_YAML = re.compile(r"""(?P<comment>(?:^|(?<=\s))\#[^\n]*)|(?P<key>^[ ]*(?:-[ ]+)*[\w./-]+(?=\s*:(?:\s|$)))|(?P<string>"(?:\\.|[^"\\])*"?|'(?:''|[^'])*'?)|(?P<word>[\w./-]+)|(?P<newline>\n)|(?P<space>[^\S\n]+)|(?P<mark>.)""", re.S | re.M | re.X)
FAMILIES = {"c": _C_LIKE, "hash": _HASH, "css": _CSS, "tags": _TAGS, "yaml": _YAML}
_BY_EXTENSION = {
    **dict.fromkeys(("c", "cc", "cpp", "h", "hpp", "js", "mjs", "ts", "java", "kt", "rs", "idl", "go"), "c"),
    **dict.fromkeys(("py", "sh", "build", "configure", "toml"), "hash"),
    "css": "css",
    **dict.fromkeys(("html", "htm", "xhtml", "xml", "xul", "svg"), "tags"),
    **dict.fromkeys(("yaml", "yml"), "yaml"),
}


def family(path: str) -> str:
    return _BY_EXTENSION.get(path.rsplit(".", 1)[-1].lower() if "." in path else "", "plain")


def tokenize(text: str, path: str) -> Iterator[Token]:
    """Tokens without white space but with newlines; every other character of the text is in exactly one token."""
    kind = family(path)
    if kind == "plain":
        at = 0
        for line in text.splitlines(keepends=True):
            body = line.rstrip("\r\n")
            if body:
                yield Token(at, body, "plain")
            if body != line:
                yield Token(at + len(body), line[len(body) :], "newline")
            at += len(line)
        return
    for m in FAMILIES[kind].finditer(text):
        group = m.lastgroup if m.lastgroup != "tag" or kind == "tags" else "raw"
        if group != "space":
            yield Token(m.start(), m[0], group or "mark")


_OUTLINES = {
    "c": re.compile(r"^\s*(?:(?:pub|export|static|async|public|private)\s+)*(class|struct|enum|interface|namespace|function|fn|trait|impl)\s+([A-Za-z_]\w*)", re.M),
    "hash": re.compile(r"^\s*(class|def|async def)\s+([A-Za-z_]\w*)", re.M),
}


def outline(text: str, path: str) -> list[tuple[int, str, str]]:
    """(line, kind, name) of definitions that the language family's patterns find."""
    pattern = _OUTLINES.get(family(path))
    return [(text.count("\n", 0, m.start(1)) + 1, m[1], m[2]) for m in pattern.finditer(text)] if pattern else []


def token_table(files: DataFrame) -> DataFrame:
    """path, start, token, kind of files (path, text)."""

    def run(batches):
        for pdf in batches:
            rows = [(p, t.start, t.text, t.kind) for p, text in zip(pdf["path"], pdf["text"], strict=True) for t in tokenize(text or "", p)]
            yield pd.DataFrame(rows, columns=["path", "start", "token", "kind"])

    return files.select("path", "text").mapInPandas(run, "path string, start long, token string, kind string")


def structural_tokens(text: str) -> list[str]:
    """``scope token`` per word; without a grammar the scope is ``%``."""
    return [f"% {w}" for w in text.split()]
