"""Filters and substitution of page templates, over columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ISSUE_URL = "https://issues.example.org/show?id="


def file_extension(path: Column) -> Column:
    """What follows the last dot; empty without one."""
    return F.when(F.contains(path, F.lit(".")), F.substring_index(path, ".", -1)).otherwise("")


def compact_path(text: Column) -> Column:
    """Spaces around slashes go, runs of spaces become one."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, " */ *", "/"), " {2,}", " "))


def issue_url(text: Column, base: str = ISSUE_URL) -> Column:
    """An address stays, anything else is an issue's number."""
    return F.when(text.startswith("http"), text).otherwise(F.concat(F.lit(base), text))


def without_prefix(text: Column, prefix: str) -> Column:
    """The rest after the prefix; empty if it is not there."""
    return F.when(text.startswith(prefix), F.substring(text, F.lit(len(prefix) + 1), F.char_length(text))).otherwise("")


def as_json(value: Column) -> Column:
    return F.to_json(value, {"pretty": "true", "ignoreNullFields": "false"})


FILTERS = {"fileext": file_extension, "compact_pathlike": compact_path, "ensure_bug_url": issue_url, "strip_prefix_or_empty": without_prefix, "downcase": F.lower, "upcase": F.upper, "strip": F.trim, "size": F.char_length}


def render(template: str, columns: dict[str, Column]) -> Column:
    """The template with ``{{ name | filter: "argument" | ... }}`` replaced; a null or unknown name is empty."""
    out, at = [], 0
    for m in re.finditer(r"\{\{\s*(\w+)((?:\s*\|\s*\w+(?:\s*:\s*\"[^\"]*\")?)*)\s*\}\}", template):
        out.append(F.lit(template[at : m.start()]))
        value = columns.get(m[1], F.lit(None).cast("string"))
        for name, argument in re.findall(r"\|\s*(\w+)(?:\s*:\s*\"([^\"]*)\")?", m[2]):
            if name not in FILTERS:
                raise ValueError(f"no filter {name}")
            value = FILTERS[name](value, argument) if name == "strip_prefix_or_empty" else FILTERS[name](value)
        out.append(F.coalesce(value.cast("string"), F.lit("")))
        at = m.end()
    return F.concat(*out, F.lit(template[at:]))
