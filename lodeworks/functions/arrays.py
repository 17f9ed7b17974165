"""Array helpers that stay linear, or nearly so, in one long array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, fold, start: Column) -> Column:
    """``fold`` of each value and all before it.

    Arrays grow by copying, so the values are folded in about as many blocks as a block has values: n values cost n ** 1.5
    copies of a number, not n ** 2.
    """

    def blocked(z: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.ceil(F.size(z["v"]) / z["width"]).cast("int") - 1)

        def part(i: Column) -> Column:
            return F.slice(z["v"], i * z["width"] + 1, z["width"])

        def grown(acc: Column, x: Column) -> Column:
            return F.concat(acc, F.array(fold(F.element_at(acc, -1), x)))

        before = F.aggregate(F.transform(blocks, lambda i: F.aggregate(part(i), start, fold)), F.array(start), grown)
        inside = let(before, lambda totals: F.transform(blocks, lambda i: F.slice(F.aggregate(part(i), F.array(F.get(totals, i)), grown), F.lit(2), z["width"])))
        return F.when(F.size(z["v"]) > 0, F.flatten(inside)).otherwise(z["v"])

    return let(F.struct(values.alias("v"), F.ceil(F.sqrt(F.size(values) + 1)).cast("int").alias("width")), blocked)


def placed(text: Column, pattern: str) -> Column:
    """(s, x) of the leftmost non-overlapping matches: where each begins, in characters from 0, and its text."""

    def of(z: Column) -> Column:
        steps = F.zip_with(F.slice(z["gaps"], 1, F.size(z["hits"])), z["hits"], lambda g, h: g + F.char_length(h))
        ends = running(steps, lambda a, b: a + b, F.lit(0))
        return F.zip_with(ends, z["hits"], lambda e, h: F.struct((e - F.char_length(h)).alias("s"), h.alias("x")))

    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), gaps.alias("gaps")), of)
