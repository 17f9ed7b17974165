"""Analysis records: newline-delimited JSON, one record a line, plain or gzipped.

Three kinds share a file, told apart by a tag key: ``target`` and ``source`` records stand at a location, ``structured``
records describe a symbol.  A malformed line is dropped, unknown keys of structured records stay in ``extra``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.locations import parse_location, parse_span

RECORD = """
  loc string, target int, source int, structured int, kind string, pretty string, sym string, context string, contextsym string,
  peekRange string, argRanges array<string>, syntax string, no_crossref int, nestingRange string, type string, typesym string,
  confidence array<string>, subsystem string, parentsym string, implKind string, sizeBytes bigint, alignmentBytes bigint,
  ownVFPtrBytes bigint,
  slotOwner struct<slotKind:string,slotLang:string,implKind:string,ownerLang:string,sym:string>,
  bindingSlots array<struct<slotKind:string,slotLang:string,implKind:string,ownerLang:string,sym:string>>,
  ontologySlots array<struct<slotKind:string,syms:array<string>>>,
  supers array<struct<sym:string,offsetBytes:bigint,props:array<string>>>,
  methods array<struct<pretty:string,sym:string,props:array<string>,labels:array<string>>>,
  fields array<struct<lineRange:string,pretty:string,sym:string,type:string,typesym:string,offsetBytes:bigint,bitPositions:struct<begin:int,width:int>,sizeBytes:bigint,labels:array<string>,pointerInfo:array<struct<kind:string,sym:string>>>>,
  overrides array<struct<sym:string>>, props array<string>, labels array<string>, platforms array<string>, canGC boolean, gcPath string
"""


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records below ``path`` with their file, a stable order ``ord`` within it, and parsed locations."""
    lines = spark.read.text(path, wholetext=False).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"), "value")
    return parse_records(lines)


def existing_path(spark: SparkSession, path: str) -> str:
    """``path`` with ``.gz`` if such a file is there, else ``path``; Spark unpacks by the ending."""
    jvm = spark.sparkContext._jvm
    packed = jvm.org.apache.hadoop.fs.Path(f"{path}.gz")
    return f"{path}.gz" if packed.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(packed) else path


def read_headed(spark: SparkSession, path: str, header: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(headers, rows) of NDJSON files whose first line is a record of its own: file and the columns of each schema."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    first = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("value"), F.min("at").alias("first"))
    heads = first.select("file", F.from_json("value", header).alias("r")).select("file", "r.*")
    rest = lines.join(first.select("file", "first"), "file").where("at <> first")
    return heads, rest.select("file", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).where("r is not null").select("file", "r.*")


def read_config(spark: SparkSession, path: str) -> dict:
    """A TOML or JSON configuration, read through Spark so that it may lie in any store; it is small and stays here."""
    import json
    import tomllib

    text = spark.read.text(path, wholetext=True).first().value
    return json.loads(text) if path.endswith(".json") else tomllib.loads(text)


def parse_records(lines: DataFrame) -> DataFrame:
    """``lines`` (file, ord, value) as typed records; a line that is no JSON object, or bears no tag, is dropped."""
    parsed = lines.select("file", "ord", F.col("value").alias("raw"), F.from_json("value", RECORD, {"mode": "PERMISSIVE"}).alias("r"))
    typed = parsed.where("r is not null").select("file", "ord", "raw", "r.*")
    kind = F.when(F.col("target") == 1, "target").when(F.col("source") == 1, "source").when(F.col("structured") == 1, "structured")
    return typed.withColumn("record_type", kind).where("record_type is not null").withColumn("place", parse_location(F.col("loc"))).withColumn("nesting", parse_span(F.col("nestingRange"))).withColumn("syms", F.split(F.col("sym"), ","))


def by_location(records: DataFrame) -> DataFrame:
    """Records grouped by place, in order of places."""
    return records.groupBy("file", "place").agg(F.sort_array(F.collect_list(F.struct("ord", "record_type", "kind", "pretty", "sym"))).alias("records")).orderBy("file", "place")


def file_symbol(mangled_path: Column, defs: Column) -> Column:
    """A file's own symbols: what line 1 defines for it, else its mangled path."""
    own = F.filter(defs, lambda s: s.startswith("FILE_"))
    return F.when(F.size(own) > 0, own).otherwise(F.array(F.concat(F.lit("FILE_"), mangled_path)))


def write_sorted(df: DataFrame, path: str, *keys: str, parts: int | None = None) -> None:
    """A keyed lookup table: range-dealt and sorted by its keys, so a lookup reads few files and row groups."""
    dealt = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def write_identifiers(identifiers: DataFrame, path: str, parts: int | None = None) -> None:
    """Identifiers in case-insensitive order, ties in byte order, with the upper-case key that prefix scans filter on."""
    write_sorted(identifiers.withColumn("id_upper", F.upper("id")), path, "id_upper", "id", "sym", parts=parts)
