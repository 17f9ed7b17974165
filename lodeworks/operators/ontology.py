"""Configured enrichment of symbols: labels by name, by class hierarchy, by owned fields; runnables of methods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import TypeRules, pointees
from ..storage import cut_lineage
from .graph import closure

#: A type is common if it has more than one field in so many; there are fewer of these.
COMMON = 1000


def labels_by_name(symbols: DataFrame, rules: DataFrame) -> DataFrame:
    """(sym, label) of rules (pretty, label) for every symbol of that name.

    Rules that repeat count once, so rows multiply by the labels of a name only.
    """
    return symbols.join(rules.select("pretty", "label").distinct(), "pretty").select("sym", "label").distinct()


def labels_of_containing_class(roots: DataFrame, subclasses: DataFrame, symbols: DataFrame) -> DataFrame:
    """(sym, label): for every transitive subclass of a rule's root (itself left out), the class its name stands in.

    ``roots`` (sym, label), ``subclasses`` (src, dst), ``symbols`` (sym, pretty).  Cycles end.
    """
    below = closure(roots.select("sym").distinct(), subclasses).where("distance > 0").join(roots.select(F.col("sym").alias("root"), "label").distinct(), "root")
    named = below.join(symbols, "sym").select(F.regexp_extract("pretty", r"^(.*)::[^:]*$", 1).alias("pretty"), "label").where("pretty <> ''")
    return named.distinct().join(symbols, "pretty").select("sym", "label").distinct()


def labels_of_field_uses(fields: DataFrame, hits: DataFrame, suffix: str, label: str) -> DataFrame:
    """(sym, label): fields that some use within a context of that ending touches."""
    used = hits.where((F.col("kind") == "use") & F.col("context").endswith(suffix)).select("sym").distinct()
    return fields.join(used, "sym", "left_semi").select("sym", F.lit(label).alias("label"))


def labels_of_owners(fields: DataFrame, rules: DataFrame) -> DataFrame:
    """(sym, label) of each class with a field of exactly the type ``class <pretty>``."""
    return fields.join(rules.select(F.concat(F.lit("class "), "pretty").alias("type"), "label").distinct(), "type").select(F.col("owner").alias("sym"), "label").distinct()


def runnables(roots: DataFrame, overridden_by: DataFrame, methods: DataFrame, hits: DataFrame) -> DataFrame:
    """(sym, constructor): for each transitive override of a root, the constructors of its class that are used anywhere.

    ``methods``: (sym, cls, pretty).  A constructor is named like its class, or ``<init>``.
    """
    overrides = closure(roots, overridden_by).select("sym").distinct().join(methods.select("sym", "cls"), "sym")
    last = F.regexp_extract("pretty", r"([^:]*)$", 1)
    made = methods.where((last == F.regexp_extract("cls", r"([^:]*)$", 1)) | (last == "<init>")).select("cls", F.col("sym").alias("constructor"))
    live = made.join(hits.select(F.col("sym").alias("constructor")).distinct(), "constructor", "left_semi")
    return overrides.join(live, "cls").select("sym", "constructor").distinct()


def merge_labels(*tables: DataFrame) -> DataFrame:
    """sym, labels: the sorted set of all."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("sym").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def pointer_edges(fields: DataFrame, rules: TypeRules, symbols: DataFrame) -> DataFrame:
    """owner, field, kind, target from fields (owner, field, type): what a type points to, as the smallest ``T_`` symbol.

    Types repeat, so each distinct one is parsed once and finds its target once.  What a common type (more than one field
    in ``COMMON``) points to is broadcast, since its fields would all be dealt to one task; the others' fields are dealt.
    """
    import pandas as pd

    def parse(batches):
        for pdf in batches:
            rows = [(t, kind, name) for t in pdf["type"] for kind, name in pointees(t, rules)[0]]
            yield pd.DataFrame(rows, columns=["type", "kind", "pretty"])

    counts = cut_lineage(fields.where("type is not null").groupBy("type").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n").alias("n")).first().n or 0
    common = [r.type for r in counts.where(F.col("n") > total / COMMON).select("type").collect()]
    parsed = counts.select("type").mapInPandas(parse, "type string, kind string, pretty string")
    named = symbols.where(F.col("sym").startswith("T_")).groupBy("pretty").agg(F.min("sym").alias("target"))
    found = cut_lineage(parsed.join(named, "pretty").select("type", "kind", "target"))
    often = F.col("type").isin(common)
    one = fields.where(often).join(F.broadcast(found.where(often)), "type")
    return one.unionByName(fields.where(~often).hint("merge").join(found, "type")).select("owner", "field", "kind", "target")
