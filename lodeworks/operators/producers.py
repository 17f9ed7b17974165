"""Producers of analysis records from plain files, by patterns on lines.

Each gives path, lno, col, kind, sym and pretty, as target records have them.
"""

from __future__ import annotations

import posixpath
import re
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Names that a substring join broadcasts, at most.
FEW_NAMES = 10_000


def _all_on_lines(lines: DataFrame, pattern: str, group: int = 1) -> DataFrame:
    """A row per match of a line: its text, its place among the line's matches, and the line."""
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    return lines.where(F.col("text").rlike(pattern)).select("path", "lno", "text", F.posexplode(found).alias("at", "name"))


def css_properties(lines: DataFrame) -> DataFrame:
    """Custom properties: a declaration after ``@property``, a definition left of a colon, else a use."""
    rows = _all_on_lines(lines, r"(--[A-Za-z_][A-Za-z0-9_-]*)")
    name = F.regexp_replace("name", "-", "\\\\-")
    decl = F.col("text").rlike(r"@property\s+--")
    defined = F.regexp_like("text", F.concat(F.lit(r"(^|[{;\s])"), name, F.lit(r"\s*:")))
    return rows.select("path", "lno", F.expr("locate(name, text) - 1").alias("col"), F.when(decl, "decl").when(defined, "def").otherwise("use").alias("kind"), F.concat(F.lit("CSS_"), "name").alias("sym"), F.col("name").alias("pretty"))


def preferences(lines: DataFrame) -> DataFrame:
    """``- name: some.pref`` lines as definitions of preferences."""
    pattern = r"^- +name: *(\S+)"
    rows = lines.where(F.col("text").rlike(pattern)).withColumn("name", F.regexp_extract("text", pattern, 1))
    return rows.select("path", "lno", F.expr("locate(name, text) - 1").alias("col"), F.lit("def").alias("kind"), F.concat(F.lit("PREF_"), F.regexp_replace("name", r"[^A-Za-z0-9_]", "_")).alias("sym"), F.col("name").alias("pretty"))


def file_uses(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Quoted strings that name a file, relative to their own directory or to the root; the nearer one counts."""
    quoted = _all_on_lines(lines, "[\"']([^\"'\\s]+)[\"']").withColumn("dir", F.regexp_extract("path", r"^(.*/)[^/]*$", 1))
    near, root = F.concat("dir", "name"), F.regexp_replace("name", "^/+", "")
    tries = quoted.withColumn("try", F.explode(F.array(F.struct(F.lit(0).alias("o"), near.alias("target")), F.struct(F.lit(1).alias("o"), root.alias("target")))))
    known = tries.join(files.select(F.col("path").alias("target")), F.col("try.target") == F.col("target"))
    return known.groupBy("path", "lno", "at", "name").agg(F.min_by("target", F.col("try.o")).alias("target")).select("path", "lno", "name", "target")


def doc_bindings(symbols: DataFrame) -> DataFrame:
    """sym, relation, lang, kind, other of ``binding_to(lang, kind, sym)`` and ``bound_as(...)`` in documentation.

    Of several owners of a symbol the first counts.
    """
    pattern = r"(binding_to|bound_as)\(\s*([^,()]+?)\s*,\s*([^,()]+?)\s*,\s*([^()]+?)\s*\)"
    whole = F.regexp_extract_all("documentation", F.lit(pattern), F.lit(0))
    each = symbols.select("sym", F.posexplode(whole).alias("at", "m"))
    rows = each.select("sym", "at", *[F.regexp_extract("m", pattern, i).alias(n) for i, n in enumerate(("relation", "lang", "kind", "other"), 1)])
    owned = rows.where("relation = 'bound_as'")
    first = rows.where("relation = 'binding_to'").groupBy("sym").agg(F.min_by(F.struct("relation", "lang", "kind", "other"), "at").alias("b")).select("sym", "b.*")
    return first.unionByName(owned.select("sym", "relation", "lang", "kind", "other"))


def symbols_with_part(names: DataFrame, symbols: DataFrame, piece: int = 8) -> DataFrame:
    """name, sym: the last symbol (by ``ord``) that holds a mangled name somewhere.

    A substring join without comparing all pairs: a symbol is found by the run of ``piece`` characters of the name that
    fewest symbols have; only those are compared in full.  Names must be that long at least.  Names are broadcast if they
    are few, counted first; symbols, whose runs no estimate foresees, never are.
    """

    def runs_of(column: str) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(column) - piece + 1), lambda i: F.substring(column, i, F.lit(piece))))

    def runs(df: DataFrame, column: str) -> DataFrame:
        return df.where(F.char_length(column) >= piece).withColumn("run", F.explode(runs_of(column)))

    names = names.select("name").distinct()
    few = names.limit(FEW_NAMES + 1).count() <= FEW_NAMES

    def sided(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df.hint("merge")

    spread, of_names = runs(symbols.select("sym", "ord"), "sym"), runs(names, "name")
    counts = spread.select("run").join(sided(of_names.select("run").distinct()), "run", "left_semi").groupBy("run").agg(F.count("*").alias("n"))
    chosen = of_names.join(sided(counts), "run").groupBy("name").agg(F.min_by("run", F.struct("n", "run")).alias("run"), F.count("*").alias("met"))
    whole = chosen.where(F.col("met") == F.size(runs_of("name")))
    hit = spread.join(sided(whole.select("name", "run")), "run").where(F.contains("sym", "name"))
    return hit.groupBy("name").agg(F.max_by("sym", "ord").alias("sym"))


def message_edges(sends: DataFrame, receives: DataFrame) -> DataFrame:
    """src, dst, kind of messages of which both sides are known."""
    return sends.select("message", F.col("sym").alias("src")).join(receives.select("message", F.col("sym").alias("dst")), "message").select("src", "dst", F.lit("ipc").alias("kind"))


def mixin_consumers(includes: DataFrame, interfaces: DataFrame) -> DataFrame:
    """mixin, consumers: the known interfaces that include each mixin, in order."""
    return includes.join(interfaces, "interface", "left_semi").groupBy("mixin").agg(F.array_join(F.array_sort(F.collect_set("interface")), ",").alias("consumers"))


def yaml_keys(files: DataFrame) -> DataFrame:
    """path, lno, key, last: dotted keys of YAML files by indentation, with the last line that each spans."""

    def read(text: str) -> list[tuple[int, str, int]]:
        out: list[list] = []
        stack: list[tuple[int, str, int]] = []
        lines = text.split("\n")
        for i, line in enumerate(lines, 1):
            body = line.lstrip(" ")
            if not body or body.startswith("#"):
                continue
            indent = len(line) - len(body)
            while stack and stack[-1][0] >= indent:
                out[stack.pop()[2]][2] = i - 1
            key, colon, _ = body.partition(":")
            if colon and key and " " not in key and not key.startswith("-"):
                stack.append((indent, ".".join([*(k for _, k, _ in stack), key]).split(".")[-1], len(out)))
                out.append([i, ".".join(k for _, k, _ in stack), len(lines)])
        return [tuple(r) for r in out]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(p, *r) for p, t in zip(pdf["path"], pdf["text"], strict=True) for r in read(t or "")], columns=["path", "lno", "key", "last"])

    return files.select("path", "text").mapInPandas(run, "path string, lno int, key string, last int")


_RECORD = "path string, lno int, col int, end int, kind string, pretty string, sym string"


def _join_path(directory: str, name: str) -> str:
    return posixpath.normpath(posixpath.join(directory, name))


def _string_places(text: str, value: str, after: int) -> int:
    """Where a quoted value stands next; -1 if it is not written out."""
    found = [i for q in "\"'" if (i := text.find(q + value + q, after)) >= 0]
    return min(found) + 1 if found else -1


def _manifest_uses(path: str, text: str) -> list[tuple[str, int, int]]:
    """(file, place, length) of the files that a test manifest names: its tables, ``include:`` ones too, and the values of
    ``support-files`` and ``head``."""
    tree = tomllib.loads(text)
    directory, uses = posixpath.dirname(path), []

    def told(value, at):
        place = _string_places(text, value, at)
        if place >= 0:
            uses.append((_join_path(directory, value.removeprefix("include:")), place, len(value)))

    def files(table, at):
        for key in ("support-files", "head"):
            if (m := re.compile(rf"^\s*{key}\s*=", re.M).search(text, at)) and key in table:
                for v in table[key] if isinstance(table[key], list) else [table[key]]:
                    if isinstance(v, str):
                        told(v, m.end())

    files(tree, 0)
    for name, table in tree.items():
        if isinstance(table, dict):
            if (m := re.search(rf"^\s*\[\s*[\"']{re.escape(name)}[\"']\s*\]", text, re.M)) is not None:
                told(name, m.start())
            head = re.search(rf"^\s*\[\s*[\"']?{re.escape(name)}[\"']?\s*\]", text, re.M)
            files(table, head.end() if head else 0)
    return uses


def manifest_files(files: DataFrame) -> DataFrame:
    """Records of TOML manifests (path, text): the manifest's own file on line 1, and each file that it names.

    A file that cannot be parsed gives no records.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                try:
                    uses = _manifest_uses(path, text or "")
                except tomllib.TOMLDecodeError:
                    continue
                rows.append((path, 1, 0, 0, "def", path, file_sym(path)))
                for name, at, n in uses:
                    lno, col = text.count("\n", 0, at) + 1, at - text.rfind("\n", 0, at) - 1
                    rows.append((path, lno, col, col + n, "use", name, file_sym(name)))
            yield pd.DataFrame(rows, columns=["path", "lno", "col", "end", "kind", "pretty", "sym"])

    return files.select("path", "text").mapInPandas(run, _RECORD)


def file_sym(path: str) -> str:
    return "FILE_" + re.sub(r"[^A-Za-z0-9_/]", lambda m: f"@{ord(m[0]):02X}", path)


_IDL_INTERFACE = re.compile(r"(?P<attributes>\[[^\]]*\])?\s*interface\s+(?P<name>\w+)\s*(?::\s*(?P<base>\w+)\s*)?\{(?P<body>[^}]*)\}")
_IDL_MEMBER = re.compile(r"(?:\[[^\]]*\]\s*)?(?:(?P<attribute>(?:readonly\s+)?attribute\s+[\w<>]+\s+(?P<a>\w+))|(?P<const>const\s+\w+\s+(?P<c>\w+)\s*=\s*[^;]+)|(?:[\w<>]+\s+(?P<m>\w+)\s*\([^)]*\)))\s*;")


def interface_records(files: DataFrame) -> DataFrame:
    """path, lno, interface, member, member_kind, scriptable, base of interface definitions and their members.

    Comments are blanked first, so places stay.
    """

    def blank(m: re.Match) -> str:
        return re.sub(r"[^\n]", " ", m[0])

    def run(batches):
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                bare = re.sub(r"/\*.*?\*/|//[^\n]*", blank, text or "", flags=re.S)
                for i in _IDL_INTERFACE.finditer(bare):
                    line = lambda at: bare.count("\n", 0, at) + 1  # noqa: B023, E731
                    scriptable = bool(re.search(r"\bscriptable\b", i["attributes"] or ""))
                    rows.append((path, line(i.start("name")), i["name"], None, "interface", scriptable, i["base"]))
                    for m in _IDL_MEMBER.finditer(i["body"]):
                        name = m["a"] or m["c"] or m["m"]
                        kind = "attribute" if m["a"] else "const" if m["c"] else "method"
                        rows.append((path, line(i.start("body") + m.start(m.lastgroup if m.lastgroup in ("a", "c", "m") else 0)), i["name"], name, kind, scriptable, i["base"]))
            yield pd.DataFrame(rows, columns=["path", "lno", "interface", "member", "member_kind", "scriptable", "base"])

    return files.select("path", "text").mapInPandas(run, "path string, lno int, interface string, member string, member_kind string, scriptable boolean, base string")


def interface_slots(members: DataFrame, symbols: DataFrame) -> DataFrame:
    """sym, slot, other: the C++ symbols (sym, pretty) of an interface's methods and attributes, and its script names.

    A method binds to ``Interface::Name``, an attribute to its getter and, unless it is read only, its setter; scripts see
    members of scriptable interfaces by their plain name.
    """
    capital = F.concat(F.upper(F.substring("member", 1, 1)), F.substring("member", F.lit(2), F.char_length("member")))
    names = F.when(F.col("member_kind") == "attribute", F.array(F.concat(F.lit("Get"), capital), F.concat(F.lit("Set"), capital))).when(F.col("member_kind") == "method", F.array(capital))
    idl = F.concat_ws("::", F.lit("XPIDL"), "interface", "member")
    native = members.where("member is not null").select(idl.alias("sym"), F.explode(names).alias("name"), "interface").select("sym", F.lit("native").alias("slot"), F.concat_ws("::", "interface", "name").alias("pretty"))
    script = members.where("member is not null and scriptable").select(idl.alias("sym"), F.lit("script").alias("slot"), F.concat(F.lit("#"), "member").alias("other"))
    return native.join(symbols.select(F.col("sym").alias("other"), "pretty"), "pretty").select("sym", "slot", "other").unionByName(script)


def script_names(properties: DataFrame) -> DataFrame:
    """Each property (object, name) bare, and with its object's name where that is known."""
    both = F.filter(F.array(F.concat(F.lit("#"), "name"), F.concat("object", F.lit("#"), "name")), lambda s: s.isNotNull())
    return properties.select("*", F.explode(both).alias("sym"))


def page_scripts(pages: DataFrame) -> DataFrame:
    """page_id, at, kind, value of pages (page_id, html): scripts, their addresses, and handlers in attributes, in order."""
    whole = r"(?is)<script\b[^>]*>|\son[a-z]+\s*=\s*(?:\"[^\"]*\"|'[^']*')"
    each = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(whole), F.lit(0))).alias("at", "m"))
    source = F.regexp_extract("m", r"(?is)\ssrc\s*=\s*[\"']([^\"']*)[\"']", 1)
    handler = F.regexp_extract("m", r"(?is)^\s(on[a-z]+)\s*=", 1)
    return each.select("page_id", "at", F.when(handler != "", "handler").when(source != "", "source").otherwise("inline").alias("kind"), F.when(handler != "", F.lower(handler)).otherwise(source).alias("value"))
