"""Revisions: lines that a revision kept, blame folded along revisions, incremental replacement, commit tables."""

from __future__ import annotations

import difflib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut_lineage
from .graph import families

#: Rows of blame that are handed over at a time.
BLAME_ROWS = 20_000
BLAME = "path string, rev long, lno int, orig_rev long, orig_lno int, orig_path string"


def kept_lines(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """(new line, old line), from 1, of the lines that a revision left as they were.

    Equal heads and tails are paired at once; only what lies between is matched block by block.
    """
    head, most = 0, min(len(old), len(new))
    while head < most and old[head] == new[head]:
        head += 1
    tail = 0
    while tail < most - head and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    a, b = old[head : len(old) - tail], new[head : len(new) - tail]
    blocks = [] if set(a).isdisjoint(b) else difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
    kept = [(i + 1, i + 1) for i in range(head)]
    kept += [(head + m.b + i + 1, head + m.a + i + 1) for m in blocks for i in range(m.size)]
    return kept + [(len(new) - i, len(old) - i) for i in reversed(range(tail))]


@dataclass
class Version:
    """A file as one revision left it; ``parents`` are the revisions whose versions it was made from, the first one first."""

    rev: int
    text: str
    parents: list[int]
    path: str = ""


def blame_versions(versions: list[Version], ignored: frozenset[int] = frozenset()) -> Iterator[tuple[int, int, int, int, str]]:
    """(rev, line, original rev, original line, original path), parents before children.

    A line is the revision's own unless a parent has it unchanged; of several parents the first counts.  A line that an
    ignored revision wrote takes the blame of the line that stood there in its first parent.
    """
    lines_of: dict[int, list[str]] = {}
    blame_of: dict[int, list[tuple[int, int, str]]] = {}
    for v in versions:
        lines = v.text.split("\n")
        now = [(v.rev, i + 1, v.path) for i in range(len(lines))]
        parents = [p for p in v.parents if p in lines_of]
        if v.rev in ignored and parents:
            before = blame_of[parents[0]]
            now = [before[i] if i < len(before) else own for i, own in enumerate(now)]
        for p in reversed(parents):
            for new, old in kept_lines(lines_of[p], lines):
                now[new - 1] = blame_of[p][old - 1]
        for i, (rev, lno, path) in enumerate(now):
            yield v.rev, i + 1, rev, lno, path
        lines_of[v.rev], blame_of[v.rev] = lines, now


def blame(versions: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """path, rev, lno, orig_rev, orig_lno, orig_path from versions (path, rev, text, and parents and old_path if there).

    ``rev`` numbers revisions, parents before children.  Without ``parents`` each version of a path follows the one
    before.  ``old_path`` names the file that a renamed or copied one went on from: its versions are folded with those of
    the new name.  Several files of a family may have one revision; a parent is the version of the old name, or else of
    the same one, in that revision.  A file's revisions must be folded in order, so they are one group: its size is one
    file's history, not the corpus.  Groups lie side by side in sorted partitions and are folded as they pass, many to a
    batch.  ``ignored`` (rev): a configured list.
    """
    skip = frozenset(r.rev for r in ignored.select("rev").distinct().collect()) if ignored is not None else frozenset()
    linear = "parents" not in versions.columns
    none = F.lit(None)
    rows = versions.select("path", "rev", "text", (none.cast("array<long>") if linear else F.col("parents").cast("array<long>")).alias("parents"), (F.col("old_path") if "old_path" in versions.columns else none.cast("string")).alias("old_path"))
    family = rows.withColumn("family", F.col("path"))
    if "old_path" in versions.columns:
        first = families(rows.where("old_path is not null").select(F.col("path").alias("a"), F.col("old_path").alias("b")))
        family = rows.join(first.withColumnRenamed("sym", "path"), "path", "left").withColumn("family", F.coalesce("first", "path"))

    def folded(group) -> Iterator[tuple]:
        made, revs, last, at = [], [], {}, {}
        for _, same in itertools.groupby(group, key=lambda r: r[2]):
            now = []
            for _, path, rev, text, given, old_path in same:
                came = path if old_path is None else old_path
                if linear:
                    parents = [last[came]] if came in last else []
                else:
                    found = (at.get((came, p), at.get((path, p), at.get(p))) for p in given or [])
                    parents = [p for p in found if p is not None]
                now.append((path, len(made)))
                made.append(Version(len(made), text or "", parents, path))
                revs.append(rev)
            for path, n in now:
                last[path] = at[path, rev] = at[rev] = n
        ignored_here = frozenset(n for n, rev in enumerate(revs) if rev in skip)
        return ((made[n].path, revs[n], lno, revs[orig], orig_lno, orig_path) for n, lno, orig, orig_lno, orig_path in blame_versions(made, ignored_here))

    import pyarrow as pa

    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string()]
    names = [c.split()[0] for c in BLAME.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out = itertools.chain.from_iterable(folded(group) for _, group in itertools.groupby(rows, key=lambda r: r[0]))
        while part := list(itertools.islice(out, BLAME_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names)

    dealt = family.select("family", "path", F.col("rev").cast("long").alias("rev"), "text", "parents", "old_path").repartition("family")
    return dealt.sortWithinPartitions("family", "rev", "path").mapInArrow(run, BLAME)


def line_changes(pairs: DataFrame) -> DataFrame:
    """key, old_lno, new_lno, text: every line of (key, old, new) text pairs, as a unified view of the whole file.

    A removed line has no new number, an added one no old number.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for key, old, new in zip(pdf["key"], pdf["old"], pdf["new"], strict=True):
                a, b = (old or "").split("\n"), (new or "").split("\n")
                i = j = 1
                for n, o in [*kept_lines(a, b), (len(b) + 1, len(a) + 1)]:
                    rows += [(key, x, None, a[x - 1]) for x in range(i, o)] + [(key, None, x, b[x - 1]) for x in range(j, n)]
                    if o <= len(a) and n <= len(b):
                        rows.append((key, o, n, b[n - 1]))
                    i, j = o + 1, n + 1
            yield pd.DataFrame(rows, columns=["key", "old_lno", "new_lno", "text"]).astype({"old_lno": "Int32", "new_lno": "Int32"})

    return pairs.select(F.col("key").cast("string"), "old", "new").mapInPandas(run, "key string, old_lno int, new_lno int, text string")


def at_revision(versions: DataFrame, rev: int) -> DataFrame:
    """path, rev, text of every file as it was at a revision: its last version up to then; a null text was removed."""
    last = versions.where(F.col("rev") <= rev).groupBy("path").agg(F.max_by(F.struct("rev", "text"), "rev").alias("v"))
    return last.select("path", "v.*").where("text is not null")


#: Share of lines, in per cent, that a renamed file has in common with the old one, at least.
RENAME_PERCENT = 30


def renames(removed: DataFrame, added: DataFrame, percent: int = RENAME_PERCENT, common: int = 100) -> DataFrame:
    """path, old_path, similarity of added files (rev, path, text) that go on from a file removed in the same revision.

    Files are paired by equal lines; a line that more than ``common`` removed files of a revision have pairs nothing, but
    counts for those paired.  Of several old files the most alike counts, then the first by path.  The joins are sorted
    ones, since no estimate foresees how many lines files have, and a broadcast of lines would meet in the driver.
    """

    def lines(df, name):
        each = df.select("rev", F.col("path").alias(name), F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''")
        return each.groupBy("rev", name, "line").agg(F.count("*").alias("n"))

    old, new = lines(removed, "old_path"), lines(added, "path")
    rare = old.groupBy("rev", "line").agg(F.count("*").alias("files")).where(F.col("files") <= common).select("rev", "line")
    pairs = old.hint("merge").join(rare, ["rev", "line"], "left_semi").select("rev", "line", "old_path").hint("merge").join(new.select("rev", "line", "path"), ["rev", "line"]).select("rev", "old_path", "path").distinct()
    shared = pairs.hint("merge").join(old.withColumnRenamed("n", "n_old"), ["rev", "old_path"]).hint("merge").join(new.withColumnRenamed("n", "n_new"), ["rev", "path", "line"]).groupBy("rev", "path", "old_path").agg(F.sum(F.least("n_old", "n_new")).alias("same"))
    sizes = [df.groupBy("rev", name).agg(F.sum("n").alias(f"of_{name}")) for df, name in ((old, "old_path"), (new, "path"))]
    scored = shared.hint("merge").join(sizes[0], ["rev", "old_path"]).hint("merge").join(sizes[1], ["rev", "path"]).withColumn("similarity", (100 * F.col("same") / F.greatest("of_path", "of_old_path")).cast("int"))
    best = scored.where(F.col("similarity") >= percent).groupBy("rev", "path").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "old_path")).alias("b"))
    return best.select("rev", "path", F.col("b.old_path").alias("old_path"), (-F.col("b.s")).alias("similarity"))


def map_counts(**maps: DataFrame) -> DataFrame:
    """name, n: how many entries each map of a tree has."""
    out = None
    for name, df in maps.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def replace_changed(state: DataFrame, fresh: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """The state without the rows of changed files, and the fresh rows."""
    return state.join(changed.select(key).distinct(), key, "left_anti").unionByName(fresh.join(changed.select(key).distinct(), key, "left_semi"))


def unchanged_files(entries: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (path, oid) that some parent has alike, and those to be read anew."""
    keys = ["path", "oid"]
    return entries.join(parents.select(*keys).distinct(), keys, "left_semi"), entries.join(parents.select(*keys).distinct(), keys, "left_anti")


def with_parents(outline: DataFrame) -> DataFrame:
    """Each name's row once for itself and once for the name that it is within."""
    parent = F.regexp_extract("pretty", r"^(.*)::[^:]*$", 1)
    return outline.withColumn("emitted", F.explode(F.filter(F.array("pretty", parent), lambda p: p != "")))


def weekly(commits: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows per ISO week, newest first."""
    return commits.groupBy(F.extract(F.lit("YEAROFWEEK"), ts).alias("iso_year"), F.weekofyear(ts).alias("iso_week")).agg(F.count("*").alias("n")).orderBy(F.desc("iso_year"), F.desc("iso_week"))


def revision_aliases(messages: DataFrame) -> DataFrame:
    """rev, alias from index messages such as ``git <id> hg <id> oldrevs a,b``: other names of a revision."""
    git = F.regexp_extract("message", r"\bgit ([0-9a-f]+)", 1)
    hg = F.regexp_extract("message", r"\bhg ([0-9a-f]+)", 1)
    old = F.filter(F.split(F.regexp_extract("message", r"\boldrevs ([0-9a-f,]+)", 1), ","), lambda x: x != "")
    return messages.select(git.alias("rev"), F.explode(F.filter(F.concat(F.array(hg), old), lambda x: x != "")).alias("alias")).where("rev <> ''")


def ignored_revisions(lines: DataFrame, column: str = "value") -> DataFrame:
    """Revisions of an ignore list: comments and blank lines go."""
    return lines.select(F.trim(F.regexp_replace(column, "#.*$", "")).alias("rev")).where("rev <> ''").distinct()


def canonical_authors(commits: DataFrame, mailmap: DataFrame) -> DataFrame:
    """name and email by a map (old_name, old_email, name, email) in which a null part is not given.

    An entry with both old parts beats one with the old mail only; a part that an entry does not give stays.  The map is a
    configured table, one entry for an old name and mail.
    """
    both = mailmap.where("old_name is not null").groupBy("old_name", "old_email").agg(F.max("name").alias("n2"), F.max("email").alias("e2"))
    mail = mailmap.where("old_name is null").groupBy(F.col("old_email").alias("m_email")).agg(F.max("name").alias("n1"), F.max("email").alias("e1"))
    joined = commits.join(both, (F.lower("author_name") == F.lower("old_name")) & (F.lower("author_email") == F.lower("old_email")), "left").join(mail, F.lower("author_email") == F.lower("m_email"), "left")
    found = F.col("old_email").isNotNull()
    name = F.when(found, F.coalesce("n2", "author_name")).otherwise(F.coalesce("n1", "author_name"))
    email = F.when(found, F.coalesce("e2", "author_email")).otherwise(F.coalesce("e1", "author_email"))
    return joined.select(*commits.columns, name.alias("name"), email.alias("email"))


def map_to_fixpoint(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """url, path: each prefix rewrite (``from_prefix`` to ``to_prefix``, longest first) until none fits.

    Rewrites that come back to an earlier path stop there.  ``prefixes`` is a configured table.
    """
    rules = sorted(((r.from_prefix, r.to_prefix) for r in prefixes.collect()), key=lambda r: len(r[0]))
    step = F.col("path")
    for old, new in rules:
        step = F.when(F.col("path").startswith(old), F.concat(F.lit(new), F.substring(F.col("path"), F.lit(len(old) + 1), F.char_length("path")))).otherwise(step)
    rows = cut_lineage(paths.select("url", F.col("url").alias("path"), F.array("url").alias("met")).withColumn("next", step))
    done = None
    while True:
        moves = (F.col("next") != F.col("path")) & ~F.array_contains("met", F.col("next"))
        ended = rows.where(~moves | F.col("next").isNull()).select("url", "path")
        done = ended if done is None else done.unionByName(ended)
        rows = cut_lineage(rows.where(moves).select("url", F.col("next").alias("path"), F.concat("met", F.array("next")).alias("met")).withColumn("next", step))
        if rows.isEmpty():
            return done
