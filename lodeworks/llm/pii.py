"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Exact patterns find the seed entities (email, ip, card, phone).  The words before a seed are lexical patterns; the same
words before a loosely similar string (a phone number without its plus, an address with a spelled-out at sign, ...) tie
that string to the seeds.  Spark scores the graph of patterns and instances over rounds: a pattern is as sure as the share
of its uses whose instances are, an instance is as sure as its patterns make it.  Occurrences of unseen instances behind
patterns of high confidence are added to the seeds.

All positions are code points from 0, ends exclusive.  Defined results: null text is empty text; without spans the digest
is that of the empty string and ``spans`` is empty; repeated rows get equal results; an empty table gives no rows.  Spans of
different kinds may overlap; an added span overlaps no seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .license_scan import let

KINDS = ["email", "ip", "card", "phone"]
#: Possessive forms: what follows a repeated class never begins with it, so these match the same text without retries.
#: A run of an email's or address's first class is entered only at its start or where the last match ended.  Cards and
#: phones ask for their least number of digits at once: shorter runs would only be found to be dropped.
SEED = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9](?=(?:[ ().-]*+[0-9]){9})[ ().0-9-]+[0-9]",
}
#: What an unseen identifier of a kind may look like.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)|@) ?[A-Za-z0-9-]{1,64}+(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]{1,64}+)*+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9A-Za-z._-])[0-9]{4}[._/][0-9]{4}[._/][0-9]{4}[._/][0-9]{2,7}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ ./-])[0-9]{3,4}[ ./-][0-9]{3,4}(?![0-9A-Za-z])",
}
CONTEXT_CHARS = 48
#: Characters in a piece of a text.
BLOCK = 256
#: Confident patterns that are named in the plan, at most; more are joined.
LISTED = 10_000
ROUNDS = 3
#: A pattern counts only if it stands before at least so many different seeds, and with at least this confidence.
MIN_SEEDS = 4
CONFIDENT = 0.9


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


def matches(text: Column, pattern: str) -> Column:
    """(s, e, x): leftmost non-overlapping matches.  Cutting the text at the matches gives the gaps, so the places."""

    def placed(z: Column) -> Column:
        steps = F.zip_with(F.slice(z["gaps"], 1, F.size(z["hits"])), z["hits"], lambda g, h: g + F.char_length(h))
        ends = running(steps, lambda a, b: a + b, F.lit(0))
        return F.zip_with(ends, z["hits"], lambda e, h: F.struct((e - F.char_length(h)).alias("s"), e.alias("e"), h.alias("x")))

    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), gaps.alias("gaps")), placed)


def blocks_of(text: Column) -> Column:
    """The text in pieces of BLOCK characters, so that a place far on is reached without passing all before it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut_out(blocks: Column, s: Column, e: Column) -> Column:
    """Characters [s, e) of a text that is given in blocks."""
    first = F.floor(s / BLOCK).cast("int")
    some = F.array_join(F.slice(blocks, first + 1, F.floor(e / BLOCK).cast("int") - first + 1), "")
    return F.when(e > s, F.substring(some, s - first * BLOCK + 1, e - s)).otherwise("")


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def add(acc: Column, i: Column) -> Column:
        v = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, v).otherwise(v * 2 - F.when(v > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _passes(kind: str, x: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
        return x.rlike(rf"^{part}(?:\.{part}){{3}}$")
    digits = F.regexp_replace(x, "[^0-9]", "")
    n = F.char_length(digits)
    if kind == "phone":
        return n.between(10, 15)
    return F.when(n.between(14, 19), let(digits, _luhn)).otherwise(False)


_SPANS = "array<struct<s:int,k:int,e:int,x:string>>"
_TOLD = "array<struct<s:int,k:int,e:int,x:string,patterns:array<string>>>"
_PLAIN = "array<struct<s:int,k:int,e:int>>"


def _found(text: Column, patterns: dict[str, str], seed: bool) -> Column:
    """Spans (s, k, e, x) of all kinds, sorted by start, then kind."""

    def of(k: int, kind: str) -> Column:
        hits = matches(text, patterns[kind])
        if seed:
            hits = F.filter(hits, lambda m: _passes(kind, m["x"]))
        return F.transform(hits, lambda m: F.struct(m["s"].alias("s"), F.lit(k).alias("k"), m["e"].alias("e"), m["x"].alias("x")))

    parts = [of(k, kind) for k, kind in enumerate(KINDS)]
    return F.when(text.rlike("[0-9@]|at[\\])]"), F.array_sort(F.concat(*parts))).otherwise(F.array().cast(_SPANS))


def _with_context(text: Column, spans: Column) -> Column:
    """Each span with its two patterns: the word before it, and the two words before it (lower case, kind in front)."""

    def of(blocks: Column):
        def one_span(m: Column) -> Column:
            before = F.lower(cut_out(blocks, F.greatest(m["s"] - CONTEXT_CHARS, F.lit(0)), m["s"]))
            kind = F.get(F.array(*map(F.lit, KINDS)), m["k"])
            one = F.regexp_extract(before, r"(?:^|\s)(\S{1,24}?):?\s*$", 1)
            two = F.regexp_extract(before, r"(?:^|\s)(\S{1,24})\s+\S{1,24}?:?\s*$", 1)
            patterns = F.array(F.concat_ws("|", kind, one), F.concat_ws("|", kind, two, one))
            return F.struct(m["s"].alias("s"), m["k"].alias("k"), m["e"].alias("e"), F.lower(m["x"]).alias("x"), F.when(one == "", F.array().cast("array<string>")).otherwise(F.array_distinct(patterns)).alias("patterns"))

        return one_span

    some = let(F.struct(blocks_of(text).alias("blocks"), spans.alias("spans")), lambda z: F.transform(z["spans"], of(z["blocks"])))
    return F.when(F.size(spans) > 0, some).otherwise(F.array().cast(_TOLD))


def apart(loose: Column, seeds: Column) -> Column:
    """The spans of ``loose`` that overlap none of ``seeds``.

    Seeds are met at their start, spans at their end: a span overlaps a seed that was met before it if the largest end of
    those lies behind the span's start.
    """

    def checked(z: Column) -> Column:
        event = lambda p, last, end, m: F.struct(p.alias("p"), F.lit(last).alias("last"), end.alias("end"), m.alias("m"))
        ends = F.transform(z["loose"], lambda m: event(m["e"], 0, F.lit(0), m))
        starts = F.transform(z["seeds"], lambda m: event(m["s"], 1, m["e"], m))
        met = F.array_sort(F.concat(ends, starts))
        far = let(met, lambda c: F.zip_with(c, running(F.transform(c, lambda x: x["end"]), lambda a, b: F.greatest(a, b), F.lit(0)), lambda x, y: F.struct(x["last"].alias("last"), y.alias("far"), x["m"].alias("m"))))
        return F.array_sort(F.transform(F.filter(far, lambda x: (x["last"] == 0) & (x["far"] <= x["m"]["s"])), lambda x: x["m"]))

    both = let(F.struct(loose.alias("loose"), seeds.alias("seeds")), checked)
    return F.when((F.size(loose) > 0) & (F.size(seeds) > 0), both).otherwise(loose)


def annotated(docs: DataFrame, *keep: Column) -> DataFrame:
    """``keep`` and seeds, loose: the seed spans of each row, and the similar strings that touch none, all with contexts."""
    text = F.coalesce(F.col("text"), F.lit("")).alias("__text")
    found = docs.select(*keep, text).select("*", _found(F.col("__text"), SEED, True).alias("seeds"), _found(F.col("__text"), LOOSE, False).alias("loose"))
    free = found.withColumn("loose", apart(F.col("loose"), F.col("seeds")))
    return free.withColumns({c: _with_context(F.col("__text"), F.col(c)) for c in ("seeds", "loose")}).drop("__text")


def annotate(docs: DataFrame) -> DataFrame:
    """doc_id, seeds, loose of each row of ``docs``."""
    return annotated(docs, F.col("doc_id").cast("long").alias("doc_id"))


def score_patterns(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """pattern, confidence from edges (pattern, x, seed, n), over rounds of passing confidence along the graph.

    The tables hold a row per pattern and instance, which identifier-like strings bound, not texts.
    """
    edges = scratch.save(edges, "edges", thin=True)
    sure = None
    for _ in range(ROUNDS):
        known = edges.withColumn("sure", F.col("seed").cast("double")) if sure is None else edges.join(sure, "x", "left").select(*edges.columns, F.greatest(F.col("seed").cast("double"), F.coalesce("belief", F.lit(0.0))).alias("sure"))
        scored = known.groupBy("pattern").agg((F.sum(F.col("n") * F.col("sure")) / F.sum("n")).alias("share"), F.sum("seed").alias("seeds"))
        patterns = scratch.save(scored.where(F.col("seeds") >= MIN_SEEDS).select("pattern", (F.col("share") * F.col("seeds") / (F.col("seeds") + 0.25)).alias("confidence")), "patterns", thin=True)
        doubt = F.sum(F.log(1 - F.least("confidence", F.lit(0.999))))
        sure = edges.where("seed = 0").join(patterns, "pattern").groupBy("x").agg((1 - F.exp(doubt)).alias("belief"))
    return patterns


def plain(spans: Column) -> Column:
    return F.transform(spans, lambda m: F.struct(m["s"].alias("s"), m["k"].alias("k"), m["e"].alias("e")))


def with_added(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rows with seeds and loose spans, told by ``row``: all else, seeds, added, the loose ones behind a confident pattern.

    Few patterns, counted, are named in the plan; more are joined to the spans.
    """
    names = [r.pattern for r in patterns.limit(LISTED + 1).collect()]
    rest = [c for c in rows.columns if c not in ("seeds", "loose")]
    seeds, empty = plain(F.col("seeds")).alias("seeds"), F.array().cast(_PLAIN)
    if len(names) <= LISTED:
        behind = F.filter("loose", lambda m: F.exists(m["patterns"], lambda p: p.isin(*names)))
        return rows.select(*rest, seeds, (plain(behind) if names else empty).alias("added"))
    some = rows.where(F.size("loose") > 0)
    unseen = some.select("row", F.explode("loose").alias("m")).select("row", "m", F.explode("m.patterns").alias("pattern"))
    accepted = unseen.join(patterns, "pattern", "left_semi").groupBy("row").agg(F.array_sort(F.collect_set(F.struct("m.s", "m.k", "m.e"))).alias("added"))
    quiet = rows.where(F.size("loose") == 0).select(*rest, seeds, empty.alias("added"))
    return quiet.unionByName(some.join(accepted, "row", "left").select(*rest, seeds, F.coalesce("added", empty).alias("added")))


def confident_patterns(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """pattern: those behind which unseen identifiers are believed, from rows with seeds and loose spans."""

    def uses(column: str) -> DataFrame:
        return rows.select(F.explode(column).alias("m")).select(F.explode("m.patterns").alias("pattern"), F.col("m.x").alias("x"))

    edges = uses("seeds").withColumn("seed", F.lit(1)).unionByName(uses("loose").withColumn("seed", F.lit(0))).groupBy("pattern", "x").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    return score_patterns(scratch, edges).where(F.col("confidence") >= CONFIDENT).select("pattern")


def extract(docs: DataFrame) -> DataFrame:
    """row, doc_id, seeds, added: spans (s, k, e) of each row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "pii")
    rows = scratch.save(annotate(docs).withColumn("row", F.monotonically_increasing_id()), "spans")
    return with_added(rows, confident_patterns(rows, scratch))


def _listed(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda m: F.concat_ws(":", F.get(kind, m["k"]), m["s"], m["e"])), ",")


def digests(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: seed counts by kind, the digest of the seed spans, and all spans as text."""

    def many(k: int, kind: str) -> Column:
        return F.size(F.filter("seeds", lambda m: m["k"] == k)).cast("long").alias(f"n_{kind}")

    count = [many(k, kind) for k, kind in enumerate(KINDS)]
    return extract(docs).select("doc_id", *count, F.sha2(_listed(F.col("seeds")), 256).alias("base_sha256"), _listed(F.concat("seeds", "added")).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with every run of overlapping spans replaced by the kind of its first in brackets; spans are sorted."""
    kind = F.array(*[F.lit(f"[{k}]") for k in KINDS])

    def cut(z: Column) -> Column:
        ends = running(F.transform(z["spans"], lambda m: m["e"]), lambda a, b: F.greatest(a, b), F.lit(0))
        reached = let(ends, lambda c: F.zip_with(z["spans"], F.concat(F.array(F.lit(0)), F.slice(c, 1, F.size(c) - 1)), lambda m, p: F.struct(m["s"].alias("s"), m["k"].alias("k"), p.alias("p"))))
        pieces = F.transform(F.filter(reached, lambda m: m["s"] >= m["p"]), lambda m: F.concat(cut_out(z["blocks"], m["p"], m["s"]), F.get(kind, m["k"])))
        return F.concat(F.array_join(pieces, ""), cut_out(z["blocks"], F.element_at(ends, -1), F.char_length(z["t"])))

    return F.when(F.size(spans) > 0, let(F.struct(text.alias("t"), spans.alias("spans"), blocks_of(text).alias("blocks")), cut)).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets and n_chars counted anew, row by row.

    Spans are found again in the row at hand, so texts are not shuffled; with very many patterns the rows are written
    once under a number of their own and added spans joined to it.  Repeated rows and rows without doc_id are masked alike.
    """
    scratch = Scratch(docs.sparkSession, "pii-added")
    kept = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col("text"))
    columns = [F.col(f"c{i}") for i in range(len(docs.columns))]
    rows = scratch.save(annotate(docs).withColumn("row", F.monotonically_increasing_id()), "spans")
    patterns = scratch.save(confident_patterns(rows, scratch), "confident", thin=True)
    if patterns.limit(LISTED + 1).count() <= LISTED:
        found = with_added(annotated(kept, *columns), patterns)
    else:
        kept = scratch.save(kept.withColumn("row", F.monotonically_increasing_id()), "rows")
        found = kept.drop("text").join(with_added(annotated(kept, F.col("row")), patterns), "row")
    text = F.col(f"c{docs.columns.index('text')}")
    spans = F.array_sort(F.concat("seeds", "added"))
    new = found.withColumn("spans", spans).withColumn("masked", F.when(text.isNotNull(), masked(text, F.col("spans"))))
    values = {"text": F.col("masked"), "n_chars": F.when(text.isNotNull(), F.char_length("masked"))}
    return new.select(*[(F.coalesce(values[c], F.col(f"c{i}")) if c in values else F.col(f"c{i}")).cast(t).alias(c) for i, (c, t) in enumerate(docs.dtypes)])
