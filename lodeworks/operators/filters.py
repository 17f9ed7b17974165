"""Record filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bare_identifier(pretty: Column) -> Column:
    """The name without the words of a description before it (``method foo::bar`` is ``foo::bar``)."""
    return F.regexp_replace(pretty, r"^[A-Za-z0-9_ ]* ", "")


def filter_records(records: DataFrame, record_types: list[str] | None = None, kind: str | None = None, symbol: str | None = None, symbol_prefix: str | None = None, identifier: str | None = None, identifier_prefix: str | None = None) -> DataFrame:
    """Records that pass every filter given.

    A source record has a kind if its comma list ``syntax`` holds it, a target record if its ``kind`` equals it, a
    structured record never.  Symbols are comma lists, any of which may match.
    """
    syms = F.split("sym", ",")
    keep = F.lit(True)
    if record_types:
        keep &= F.col("record_type").isin(*record_types)
    if kind is not None:
        keep &= F.when(F.col("record_type") == "source", F.array_contains(F.split("syntax", ","), kind)).when(F.col("record_type") == "target", F.col("kind") == kind).otherwise(False)
    if symbol is not None:
        keep &= F.array_contains(syms, symbol)
    if symbol_prefix is not None:
        keep &= F.exists(syms, lambda s: s.startswith(symbol_prefix))
    if identifier is not None:
        keep &= bare_identifier(F.col("pretty")) == identifier
    if identifier_prefix is not None:
        keep &= bare_identifier(F.col("pretty")).startswith(identifier_prefix)
    return records.where(F.coalesce(keep, F.lit(False)))
