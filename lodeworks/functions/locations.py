"""Source locations: ``line:col`` or ``line:from-to`` (line from 1, padded to five digits; columns from 0, end exclusive)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOC = r"^0*([0-9]+):([0-9]+)(?:-([0-9]+))?$"
_LINES = r"^([0-9]+)-([0-9]+)$"
_SPAN = r"^([0-9]+):([0-9]+)-([0-9]+):([0-9]+)$"
#: A start of 0 or of all ones in 32 bits means that there is no range.
_NONE = (0, 4294967295)


def _part(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(c, pattern, group).try_cast("bigint")


def parse_location(c: Column) -> Column:
    """struct<lineno, col_start, col_end>; a single column is an empty range; malformed text is null."""
    start = _part(c, _LOC, 2)
    parsed = F.struct(_part(c, _LOC, 1).alias("lineno"), start.alias("col_start"), F.coalesce(_part(c, _LOC, 3), start).alias("col_end"))
    return F.when(c.rlike(_LOC), parsed)


def format_location(line: Column, start: Column, end: Column) -> Column:
    head = F.concat(F.lpad(line.cast("string"), 5, "0"), F.lit(":"), start.cast("string"))
    return F.when(start == end, head).otherwise(F.concat(head, F.lit("-"), end.cast("string")))


def parse_line_range(c: Column) -> Column:
    """struct<first, last>, null if empty (both ends 0, or both all ones) or malformed."""
    a, b = _part(c, _LINES, 1), _part(c, _LINES, 2)
    empty = ((a == 0) & (b == 0)) | ((a == _NONE[1]) & (b == _NONE[1]))
    return F.when(c.rlike(_LINES) & ~empty, F.struct(a.alias("first"), b.alias("last")))


def parse_span(c: Column) -> Column:
    """struct<l1, c1, l2, c2> of ``l1:c1-l2:c2``, null if its first line is no line or the text is malformed."""
    parts = [_part(c, _SPAN, i).alias(n) for i, n in enumerate(("l1", "c1", "l2", "c2"), 1)]
    return F.when(c.rlike(_SPAN) & ~parts[0].isin(*_NONE), F.struct(*parts))


def union_spans(span: Column) -> Column:
    """Aggregate: the smallest span that covers all non-null ones."""
    first = F.min(F.when(span.isNotNull(), F.struct(span["l1"].alias("l"), span["c1"].alias("c"))))
    last = F.max(F.when(span.isNotNull(), F.struct(span["l2"].alias("l"), span["c2"].alias("c"))))
    return F.when(first.isNotNull(), F.struct(first["l"].alias("l1"), first["c"].alias("c1"), last["l"].alias("l2"), last["c"].alias("c2")))
