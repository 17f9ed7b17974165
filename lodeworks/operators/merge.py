"""Merging the records of several platforms' builds of one file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.locations import union_spans


def with_platforms(inputs: dict[str, DataFrame]) -> DataFrame:
    """The platforms' records in one table, with their platform and its place in the given order."""
    out = None
    for i, (name, df) in enumerate(inputs.items()):
        one = df.withColumn("platform", F.lit(name)).withColumn("platform_ord", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


def merge_targets(records: DataFrame, columns: list[str]) -> DataFrame:
    """Equal target records once, in order of first sight (``first_ord``)."""
    return records.groupBy(*columns).agg(F.min(F.struct("platform_ord", "ord")).alias("first_ord"))


def merge_sources(records: DataFrame, keys: list[str]) -> DataFrame:
    """One source record per place and name.

    A record is out of the cross-reference only if it is on every platform; syntax is the sorted set of all; symbols keep
    first sight, later platforms first; nesting is the union; the type is the first that is there.
    """
    order = F.struct("platform_ord", "ord")
    seen = F.sort_array(F.collect_list(F.struct("platform_ord", (-F.col("ord")).alias("o"), "sym")), asc=False)
    syms = F.array_distinct(F.flatten(F.transform(seen, lambda s: F.split(s["sym"], ","))))
    return records.groupBy(*keys).agg(
        F.bool_and(F.col("no_crossref") == 1).alias("no_crossref"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("syntax", ","))))), ",").alias("syntax"),
        F.array_join(syms, ",").alias("sym"),
        union_spans(F.col("nesting")).alias("nesting"),
        F.min_by("type", F.when(F.col("type").isNotNull(), order)).alias("type"),
    )


def merge_structured(records: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per symbol: the form of the highest platform, with each other form as a variant, all with their platforms.

    Forms are compared by the named columns; variants stand in order of their joined platform names.
    """
    form = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    forms = records.withColumn("form", form).groupBy(key, "form").agg(F.sort_array(F.collect_set(F.struct("platform_ord", "platform"))).alias("p"))
    named = forms.withColumn("platforms", F.array_join(F.transform("p", lambda x: x["platform"]), ",")).withColumn("top", F.array_max(F.transform("p", lambda x: x["platform_ord"])))
    merged = named.groupBy(key).agg(F.max_by(F.struct("form", "platforms"), "top").alias("canonical"), F.sort_array(F.collect_list(F.struct("platforms", "form"))).alias("all"))
    variants = F.filter("all", lambda v: v["form"] != F.col("canonical.form"))
    return merged.select(key, F.col("canonical.form").alias("form"), F.col("canonical.platforms").alias("platforms"), F.size("all").alias("n_forms"), variants.alias("variants"))


def per_platform(merged: DataFrame, key: str) -> DataFrame:
    """Merged structured records back to one row per platform; a platform's first form counts."""
    forms = F.concat(F.array(F.struct(F.lit(0).alias("at"), "platforms", "form")), F.transform("variants", lambda v, i: F.struct((i + 1).alias("at"), v["platforms"].alias("platforms"), v["form"].alias("form"))))
    rows = merged.select(key, F.explode(forms).alias("f")).select(key, "f.at", F.explode(F.split("f.platforms", ",")).alias("platform"), F.col("f.form").alias("form"))
    return rows.groupBy(key, "platform").agg(F.min_by("form", "at").alias("form"))


#: How sure a symbol of a source record is, the least sure first.
CONFIDENCE = ["cppTemplateHeuristic", "concrete"]


def merge_confidence(records: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sym, confidence: of each symbol of a place (``syms`` beside ``confidence``, arrays) the surest there is."""
    level = F.array_position(F.array(*map(F.lit, CONFIDENCE)), F.col("c"))
    each = records.select(*keys, F.explode(F.arrays_zip("syms", "confidence")).alias("z")).select(*keys, F.col("z.syms").alias("sym"), F.col("z.confidence").alias("c"))
    best = each.where("sym is not null").groupBy(*keys, "sym").agg(F.max(level).alias("level"))
    return best.select(*keys, "sym", F.get(F.array(*map(F.lit, CONFIDENCE)), (F.col("level") - 1).cast("int")).alias("confidence"))


def merge_expansions(records: DataFrame, keys: list[str]) -> DataFrame:
    """keys, expansion: the expansions of a place by name and platform, one map of JSON texts.

    ``expansion`` is a map of a name to what it expands to.  A place whose records disagree on one kind of expansion
    (``expansion_kind``) is an error of the inputs and raises where the row is read.
    """
    each = records.where("expansion is not null").select(*keys, "platform_ord", "expansion_kind", F.explode("expansion").alias("name", "to"))
    agreed = F.when(F.min("least") == F.max("most"), F.lit(True)).otherwise(F.raise_error(F.lit("two kinds of expansions at one place")).cast("boolean"))
    one = each.groupBy(*keys, "name").agg(F.max_by("to", "platform_ord").alias("to"), F.min("expansion_kind").alias("least"), F.max("expansion_kind").alias("most"))
    return one.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "to")))).alias("expansion"), agreed.alias("agreed")).where("agreed").drop("agreed")
