"""Configured evaluation of JSON values: pointer, fallback, map, aggregate, object; and walkers of nested trees."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F


def pointer_path(pointer: str) -> str:
    """A JSON path for a JSON pointer (``/a/0/b`` is ``$.a[0].b``)."""
    parts = [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in parts)


def evaluate(json: Column, pointer: str | None = None, null_fallback: str | None = None, first_index: int | None = None, aggregation: str | None = None) -> Column:
    """The value (as text) that the steps give, in this order; a pointer that leads nowhere gives null.

    ``first_index`` keeps an array from that place on; ``aggregation="length"`` counts an array's items or an object's keys.
    """
    if aggregation not in (None, "length"):
        raise ValueError(f"aggregation {aggregation!r} is not known")
    value = json if pointer in (None, "") else F.get_json_object(json, pointer_path(pointer))
    if null_fallback is not None:
        value = F.coalesce(value, F.lit(null_fallback))
    if first_index is not None:
        items = F.from_json(value, "array<string>")
        value = F.to_json(F.slice(items, first_index + 1, F.greatest(F.size(items) - first_index, F.lit(0))))
    if aggregation == "length":
        keys = F.size(F.json_object_keys(value))
        value = F.coalesce(F.json_array_length(value), F.when(keys >= 0, keys)).cast("string")
    return value


def nested_dirs(node: dict, path: str = "") -> Iterator[tuple[str, object]]:
    """(path, value) of a tree whose directories are objects and whose files are values."""
    for name, child in node.items():
        at = f"{path}/{name}" if path else name
        if isinstance(child, dict):
            yield from nested_dirs(child, at)
        else:
            yield at, child


def dict_of_arrays(node: dict) -> Iterator[tuple[str, object]]:
    """(key, item) of an object of arrays."""
    for key, items in node.items():
        for item in items:
            yield key, item


def flat_dirs(node: dict) -> Iterator[tuple[str, object]]:
    """(path, value) of an object of directories, whose files are keys."""
    for directory, files in node.items():
        for name, value in files.items():
            yield f"{directory}/{name}" if directory else name, value


WALKERS = {"dirs-are-dicts": nested_dirs, "dict-of-arrays": dict_of_arrays, "files-are-keys": flat_dirs}


def walk(kind: str, node: dict) -> Iterator[tuple[str, object]]:
    if kind not in WALKERS:
        raise ValueError(f"nesting {kind!r} is not known")
    return WALKERS[kind](node)
