"""Graph operators over symbols: traversal by edge kinds, relation expansion, simple paths, hierarchy.

Edges are a DataFrame (src, dst, kind, and ``ord`` where order matters).  A traversal is a loop of joins on the driver, at
most ``MAX_DEPTH`` rounds; each round's frontier is written to the shared checkpoint folder, so lineage stays short and a
lost executor costs a reread.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut_lineage

MAX_DEPTH = 8
NODE_LIMIT = 384
PATH_NODE_LIMIT = 8192
#: A symbol used in so many paths is not walked further.
SKIP_USES = 16
LOCAL_LIMIT = 100
#: Symbols that a walk may start from, and paths that an enumeration may hold.
SEEDS = 10_000
PATHS = 1_000_000
GLOBAL_LIMIT = 400


def traverse(seeds: DataFrame, edges: DataFrame, max_depth: int = MAX_DEPTH, stop: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that a breadth-first walk from ``seeds`` (sym) meets.

    Nodes bear the depth at which they were first met, edges the depth of their source.  A neighbour at ``max_depth`` gets
    its node and edge but is not walked from.  Symbols in ``stop`` (sym) are met but not walked from, unless they are seeds.
    """
    frontier = seeds.select("sym").distinct().withColumn("depth", F.lit(0))
    visited = found = cut_lineage(frontier)
    frontier, walked = visited, None
    for depth in range(max_depth):
        out = frontier.select(F.col("sym").alias("src")).join(edges, "src").select("src", "dst", "kind").distinct().withColumn("depth", F.lit(depth))
        out = cut_lineage(out)
        walked = out if walked is None else walked.unionByName(out)
        fresh = out.select(F.col("dst").alias("sym")).distinct().join(visited.select("sym"), "sym", "left_anti").withColumn("depth", F.lit(depth + 1))
        fresh = cut_lineage(fresh)
        if fresh.isEmpty():
            break
        found = found.unionByName(fresh)
        visited = found
        frontier = fresh if stop is None else fresh.join(stop.select("sym"), "sym", "left_anti")
    return found, walked if walked is not None else edges.where("false").select("src", "dst", "kind").withColumn("depth", F.lit(0))


def traverse_limited(seeds: list[str], edges: DataFrame, max_depth: int = MAX_DEPTH, node_limit: int = NODE_LIMIT, ignore: frozenset[str] = frozenset(), stop: frozenset[str] = frozenset()) -> tuple[list[tuple[str, int]], list[tuple[str, str, str]], list[dict]]:
    """Breadth-first walk with a limit on nodes: (nodes with depth, edges, overloads), all in order of the walk.

    The limit is looked at when a node is taken from the queue and makes the result small, so the walk keeps its state on
    the driver and fetches one level's edges at a time, in ``ord`` order; the fetch of a level is cut where the limit must
    already be reached.
    """
    depth_of, nodes, out, overloads = {}, [], [], []
    queue: list[str] = []
    for s in seeds:
        if s not in depth_of:
            depth_of[s] = 0
            nodes.append((s, 0))
            queue.append(s)
    while queue:
        level = edges.where(F.col("src").isin(queue))
        ranked = level.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("ord", "dst"))).where(F.col("r") <= node_limit + 1)
        by: dict[str, list] = {}
        for r in ranked.orderBy("src", "r").select("src", "dst", "kind").collect():
            by.setdefault(r.src, []).append(r)
        following = []
        for sym in queue:
            if len(nodes) >= node_limit:
                overloads.append({"kind": "NodeLimit", "sym": sym, "exist": len(nodes), "included": node_limit})
                return nodes, out, overloads
            if sym in ignore:
                continue
            for r in by.get(sym, []):
                out.append((r.src, r.dst, r.kind))
                if r.dst in depth_of:
                    continue
                depth_of[r.dst] = depth_of[sym] + 1
                nodes.append((r.dst, depth_of[r.dst]))
                if depth_of[r.dst] >= max_depth:
                    overloads.append({"kind": "DepthLimit", "sym": r.dst, "exist": depth_of[r.dst], "included": max_depth})
                elif r.dst not in stop:
                    following.append(r.dst)
        queue = following
    return nodes, out, overloads


@dataclass(frozen=True)
class Step:
    """How a walk follows one relation of a symbol.

    ``inward``: the edge leads to the symbol.  ``kind``: the edge's, or None for the relation row's own.  ``ends``: if the
    symbol has such rows, its later relations are not followed.  ``once``: a neighbour met before gets no edge.  ``turn``:
    after this step only steps of the same turn, or without one, are followed.  ``edge``: False only schedules.
    """

    relation: str
    limit: str
    inward: bool = False
    kind: str | None = "default"
    ends: bool = False
    once: bool = False
    turn: str = ""
    edge: bool = True


_IDL = Step("slot_idl", "DepthLimitOnBindingSlot", inward=True, kind="implementation")
_SUBCLASSES = Step("subclasses", "DepthLimitOnSubclass", kind="inheritance", turn="sub")
_SUPERS = Step("supers", "DepthLimitOnSuper", inward=True, kind="inheritance", turn="super")
_OVERRIDES = Step("overrides", "DepthLimitOnOverrides", inward=True, kind="implementation", once=True)
_OVERRIDDEN = Step("overriddenBy", "DepthLimitOnOverriddenBy", kind="implementation", once=True)
#: The relations that each kind of walk follows, in this order.
WALKS = {
    "class": (Step("fields", "DepthLimitOnFieldPointer", kind=None), Step("member_uses", "DepthLimitOnFieldMemberUses", edge=False), _IDL, _SUBCLASSES, _SUPERS),
    "callees": (
        Step("slot_send", "DepthLimitOnBindingSlot", kind="ipc", ends=True),
        _IDL,
        Step("slot_other", "DepthLimitOnBindingSlot", kind="cross-language", ends=True),
        Step("runnable_method", "DepthLimitOnOntologySlot", ends=True),
        _OVERRIDDEN,
        Step("callees", "DepthLimitOnCallees"),
    ),
    "uses": (
        Step("slot_recv", "DepthLimitOnBindingSlot", inward=True, kind="ipc", ends=True),
        _IDL,
        Step("binding", "DepthLimitOnBindingSlot", inward=True, kind="cross-language", ends=True),
        Step("runnable_constructor", "DepthLimitOnOntologySlot", inward=True, ends=True),
        _OVERRIDES,
        Step("uses", "DepthLimitOnUses", inward=True),
    ),
    "inheritance": (_IDL, _SUBCLASSES, _SUPERS, _OVERRIDES, _OVERRIDDEN),
}
#: Label that keeps a walk from going on at a symbol, and the prefix of labels that put a badge in place of a super edge.
STOP = {"class": "class-diagram:stop", "callees": "calls-diagram:stop", "uses": "uses-diagram:stop"}
BADGE = "class-diagram:elide-and-badge:"


@dataclass
class Walk:
    """What a walk met, in its order: nodes with depth, edges (src, dst, kind), limits that were hit, badges."""

    nodes: dict[str, int] = field(default_factory=dict)
    edges: dict[tuple[str, str], str] = field(default_factory=dict)
    overloads: list[dict] = field(default_factory=list)
    badges: list[tuple[str, str]] = field(default_factory=list)


def _fetch(links: DataFrame, queue: list[str], relations: list[str], most: int) -> dict[tuple[str, str], list]:
    """A level's relation rows by (symbol, relation), in order, at most ``most`` a list; uses come with counts of paths."""
    level = links.where(F.col("sym").isin(queue) & F.col("relation").isin(relations))
    # Uses are ordered by path, then line; a list too long is cut before it reaches the driver.
    listed = Window.partitionBy("sym", "relation").orderBy("path", "ord", "other")
    paths = level.groupBy("sym", "relation").agg(F.count_distinct("path").alias("paths"))
    in_path = level.groupBy("sym", "relation", "path").agg(F.count("*").alias("lines"))
    counted = level.withColumn("at", F.row_number().over(listed)).where(F.col("at") <= most)
    rows = counted.join(paths, ["sym", "relation"])
    rows = rows.join(in_path.select("sym", "relation", F.coalesce("path", F.lit("")).alias("in_path"), "lines"), ["sym", "relation"]).where(F.coalesce("path", F.lit("")) == F.col("in_path"))
    by: dict[tuple[str, str], list] = {}
    for r in rows.select("sym", "relation", "other", "kind", "path", "paths", "lines", "at").orderBy("sym", "relation", "at").collect():
        by.setdefault((r.sym, r.relation), []).append(r)
    return by


def _within_uses(sym: str, rows: list, skip_at: int, overloads: list[dict]) -> list:
    """The uses that a walk follows: none of a symbol in too many paths, and none from a path on that has too many lines."""
    if rows and rows[0].paths >= skip_at:
        overloads.append({"kind": "UsesPaths", "sym": sym, "exist": rows[0].paths, "included": 0, "local_limit": skip_at, "global_limit": 0})
        return []
    kept, total, path = [], 0, None
    for r in rows:
        if r.path != path or not kept:
            path = r.path
            if r.lines >= skip_at:
                overloads.append({"kind": "UsesLines", "sym": sym, "exist": r.lines, "included": 0, "local_limit": skip_at, "global_limit": 0})
                break
            total += r.lines
            if total >= skip_at:
                overloads.append({"kind": "UsesLines", "sym": sym, "exist": total, "included": total - r.lines, "local_limit": 0, "global_limit": skip_at})
                break
        kept.append(r)
    return kept


def walk(
    seeds: list[str],
    links: DataFrame,
    mode: str,
    labels: DataFrame | None = None,
    names: DataFrame | None = None,
    max_depth: int = MAX_DEPTH,
    node_limit: int = NODE_LIMIT,
    skip_uses_at: int = SKIP_USES,
    ignore: frozenset[str] = frozenset(),
    member_uses_depth: int = 0,
) -> Walk:
    """Breadth-first walk along the relations of a kind of diagram, with its limits.

    ``links``: sym, relation, other, kind, path, ord; ``labels``: sym, label; ``names``: sym, pretty.  The node limit is
    looked at when a symbol's turn comes, a neighbour at ``max_depth`` is not walked from, one whose name is in ``ignore``
    gets no edge, and one of several edges of a pair keeps the first kind.  The limits bound what is met, so the walk keeps
    its state on the driver and fetches one level's relations at a time.
    """
    steps, out = WALKS[mode], Walk()
    queue = [(s, 0, frozenset(("sub", "super"))) for s in dict.fromkeys(seeds)]
    out.nodes.update((s, 0) for s, _, _ in queue)
    met = set(out.nodes)
    while queue:
        syms = [s for s, _, _ in queue]
        by = _fetch(links, syms, [s.relation for s in steps], max(node_limit + 1, skip_uses_at))
        others = sorted({r.other for rows in by.values() for r in rows})
        told: dict[str, set[str]] = {}
        if labels is not None:
            for r in labels.where(F.col("sym").isin(syms + others)).distinct().collect():
                told.setdefault(r.sym, set()).add(r.label)
        ignored = {r.sym for r in names.where(F.col("sym").isin(others) & F.col("pretty").isin(sorted(ignore))).collect()} if ignore and names is not None else set()
        following = []
        for sym, depth, turns in queue:
            if len(out.nodes) >= node_limit:
                out.overloads.append({"kind": "NodeLimit", "sym": sym, "exist": len(out.nodes), "included": len(out.nodes), "local_limit": 0, "global_limit": node_limit})
                return out
            if depth and STOP.get(mode) in told.get(sym, ()):
                continue
            for step in steps:
                if step.turn and step.turn not in turns or step.relation == "member_uses" and depth > member_uses_depth:
                    continue
                rows = by.get((sym, step.relation), [])
                for r in _within_uses(sym, rows, skip_uses_at, out.overloads) if step.relation == "uses" else rows:
                    badge = next((x.removeprefix(BADGE) for x in sorted(told.get(r.other, ())) if x.startswith(BADGE)), None)
                    if step.relation == "supers" and badge is not None:
                        out.badges.append((sym, badge))
                        continue
                    out.nodes.setdefault(r.other, depth + 1)
                    if r.other in ignored or step.once and r.other in met:
                        continue
                    if step.edge:
                        ends = (r.other, sym) if step.inward else (sym, r.other)
                        out.edges.setdefault(ends, step.kind or r.kind)
                    if r.other in met:
                        continue
                    met.add(r.other)
                    if depth + 1 >= max_depth:
                        out.overloads.append({"kind": step.limit, "sym": r.other, "exist": depth + 1, "included": depth + 1, "local_limit": max_depth, "global_limit": 0})
                        continue
                    following.append((r.other, depth + 1, frozenset((step.turn,)) if step.turn else frozenset(("sub", "super"))))
                if rows and step.ends:
                    break
        queue = following
    return out


def edges_between(edges: list[tuple[str, str]], sources: set[str], targets: set[str], max_nodes: int, node_limit: int = PATH_NODE_LIMIT) -> list[tuple[str, str]]:
    """The edges of simple paths of at most ``max_nodes`` nodes from a source to a target, in the order of their paths.

    Looked at path by path: once ``node_limit`` nodes lie on paths no more are added.  A step that can no longer reach a
    target in time is not tried.
    """
    after: dict[str, list[str]] = {}
    before: dict[str, list[str]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
        before.setdefault(b, []).append(a)
    left, ring = dict.fromkeys(targets, 1), list(targets)
    while ring:
        ring = [p for n in ring for p in before.get(n, ()) if p not in left and left.setdefault(p, left[n] + 1)]
    found: dict[tuple[str, str], None] = {}
    on_path: set[str] = set()
    for start in sorted(sources):
        way, tries = [start], [iter(after.get(start, ()))]
        while way:
            step = next(tries[-1], None)
            if step is None:
                way.pop()
                tries.pop()
            elif step not in way and len(way) + left.get(step, max_nodes + 1) <= max_nodes:
                way.append(step)
                tries.append(iter(after.get(step, ())))
                if step in targets:
                    if len(on_path) >= node_limit:
                        return list(found)
                    on_path.update(way)
                    found.update(dict.fromkeys(zip(way, way[1:])))
    return list(found)


def uses_edges(hits: DataFrame, skip_at: int = SKIP_USES) -> tuple[DataFrame, DataFrame]:
    """(edges caller -> sym, overloads) from use hits (sym, path, contextsym): a symbol used in too many paths is skipped."""
    count = hits.groupBy("sym").agg(F.countDistinct("path").alias("n_paths"))
    kept = hits.join(count.where(F.col("n_paths") < skip_at).select("sym"), "sym", "left_semi")
    edges = kept.select(F.col("contextsym").alias("src"), F.col("sym").alias("dst"), F.lit("default").alias("kind")).distinct()
    return edges, count.where(F.col("n_paths") >= skip_at).select("sym", F.lit("UsesPaths").alias("kind"), F.col("n_paths").alias("exist"), F.lit(0).alias("included"), F.lit(skip_at).alias("local_limit"))


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row per (src, dst): the first kind by ``ord``, and how many edges it stands for."""
    return edges.groupBy("src", "dst").agg(F.min_by("kind", "ord").alias("kind"), F.count("*").alias("n_edges"))


def _few(seeds: DataFrame) -> list[str]:
    """The seeds of a walk that keeps its state on the driver, in order; too many are refused before they are fetched."""
    found = [r.sym for r in seeds.select("sym").distinct().orderBy("sym").limit(SEEDS + 1).collect()]
    if len(found) > SEEDS:
        raise ValueError(f"more than {SEEDS} symbols to start from")
    return found


def expand_relations(seeds: DataFrame, relations: DataFrame, local_limit: int | None = LOCAL_LIMIT, global_limit: int | None = GLOBAL_LIMIT, every_way: bool = False) -> tuple[DataFrame, list[dict]]:
    """sym, relation, root, distance of the symbols that relations tie to the seeds, and the lists that were too long.

    ``relations`` holds (sym, relation, other): ``overrides`` and ``supers`` lead up, ``overriddenBy`` and ``subclasses``
    down.  From a seed all four are followed; what was reached upwards also gives its other children as cousins; what was
    reached downwards goes on downwards.  A list longer than ``local_limit`` is skipped whole, as is one that would push
    the total above ``global_limit``; upward lists are never skipped.  The limits bound the frontier, so it is kept here.
    With None for both no list is skipped, and the frontier, which nothing then bounds, is joined and written in rounds.

    A symbol is given once, by the way that is met first.  With ``every_way``, which takes no limits, it is given for each
    relation, root and distance that ways to it have, with their number in ``ways``: a relation listed twice makes two.
    """
    if (local_limit is None) != (global_limit is None):
        raise ValueError("give both limits or neither")
    if every_way and local_limit is not None:
        raise ValueError("every way is followed without limits only")
    step = {
        ("Queried", "overriddenBy"): "OverrideOf",
        ("Queried", "overrides"): "OverriddenBy",
        ("Queried", "subclasses"): "SubclassOf",
        ("Queried", "supers"): "SuperclassOf",
        ("OverriddenBy", "overrides"): "OverriddenBy",
        ("OverriddenBy", "overriddenBy"): "CousinOverrideOf",
        ("SuperclassOf", "supers"): "SuperclassOf",
        ("SuperclassOf", "subclasses"): "CousinClassOf",
        ("OverrideOf", "overriddenBy"): "OverrideOf",
        ("SubclassOf", "subclasses"): "SubclassOf",
        ("CousinOverrideOf", "overriddenBy"): "CousinOverrideOf",
        ("CousinClassOf", "subclasses"): "CousinClassOf",
    }
    if local_limit is None:
        return (_expand_ways if every_way else _expand_all)(seeds, relations, step), []
    queue = [(s, "Queried", s, 0) for s in _few(seeds)]
    met, rows, overloads = {q[0] for q in queue}, list(queue), []
    used = {"overriddenBy": 0, "subclasses": 0}
    while queue:
        around = relations.where(F.col("sym").isin(sorted({q[0] for q in queue})))
        listed = around.groupBy("sym", "relation").agg(F.count("*").alias("n"))
        fits = listed.where((F.col("n") <= local_limit) | F.col("relation").isin("overrides", "supers"))
        others = around.join(fits, ["sym", "relation"]).groupBy("sym", "relation").agg(F.array_sort(F.collect_set("other")).alias("others"))
        table = {(r.sym, r.relation): (r.n, r.others) for r in listed.join(others, ["sym", "relation"], "left").collect()}
        following = []
        for sym, state, root, distance in queue:
            for relation in ("overriddenBy", "overrides", "subclasses", "supers"):
                if (state, relation) not in step or (sym, relation) not in table:
                    continue
                n, others = table[sym, relation]
                if relation in used:
                    if n > local_limit or used[relation] + n > global_limit:
                        overloads.append({"kind": relation, "sym": sym, "exist": n, "included": 0, "local_limit": local_limit if n > local_limit else 0, "global_limit": global_limit if n <= local_limit else 0})
                        continue
                    used[relation] += n
                for other in others:
                    if other not in met:
                        met.add(other)
                        following.append((other, step[state, relation], root, distance + 1))
        rows += following
        queue = following
    return seeds.sparkSession.createDataFrame(rows, "sym string, relation string, root string, distance int"), overloads


#: Relations in the order in which a queue takes them.
_FOLLOWED = ("overriddenBy", "overrides", "subclasses", "supers")


def _onward(frontier: DataFrame, links: DataFrame, step: dict[tuple[str, str], str]) -> DataFrame:
    """The frontier (q) with the links (r) that lead on from it, and ``to``, what they make of what they reach."""
    moves = F.create_map(*[F.lit(x) for (state, relation), to in step.items() for x in (f"{state}/{relation}", to)])
    ways = frontier.alias("q").join(links.alias("r"), F.col("q.sym") == F.col("r.sym"))
    return ways.withColumn("to", F.try_element_at(moves, F.concat_ws("/", "q.relation", "r.relation"))).where("to is not null")


def _expand_all(seeds: DataFrame, relations: DataFrame, step: dict[tuple[str, str], str]) -> DataFrame:
    """The rows of ``expand_relations`` without limits, a join for each round.

    Of several ways to a symbol the one counts that a queue would take first: ``turn`` lists, from the seed on, the
    relation's place and the symbol of each step.
    """
    place = F.array_position(F.array(*map(F.lit, _FOLLOWED)), F.col("r.relation")).cast("string")
    links = relations.where(F.col("relation").isin(*_FOLLOWED)).select("sym", "relation", "other")
    found = frontier = cut_lineage(seeds.select("sym").distinct().select("sym", F.lit("Queried").alias("relation"), F.col("sym").alias("root"), F.lit(0).alias("distance"), F.array("sym").alias("turn")))
    while not frontier.isEmpty():
        ways = _onward(frontier, links, step)
        turn = F.concat("turn", F.array(place, F.col("r.other")))
        first = ways.select(F.col("r.other").alias("sym"), F.col("to").alias("relation"), "root", (F.col("distance") + 1).alias("distance"), turn.alias("turn")).groupBy("sym").agg(F.min_by(F.struct("relation", "root", "distance", "turn"), "turn").alias("w")).select("sym", "w.*")
        frontier = cut_lineage(first.join(found.select("sym"), "sym", "left_anti"))
        found = found.unionByName(frontier)
    return found.drop("turn")


def _expand_ways(seeds: DataFrame, relations: DataFrame, step: dict[tuple[str, str], str]) -> DataFrame:
    """The rows of ``expand_relations`` by every way, a join for each round.

    Ways that end alike are one row with their number, so that a round joins each link once at most for a root and a
    relation, however many ways lead to it.  Symbols without a name are ends.
    """
    links = relations.where(F.col("relation").isin(*_FOLLOWED)).select("sym", "relation", "other")
    longest = 2 * links.select("sym").distinct().count() + 1  # upwards and downwards, a way passes a symbol once each
    found = frontier = cut_lineage(seeds.select("sym").distinct().select("sym", F.lit("Queried").alias("relation"), F.col("sym").alias("root"), F.lit(0).alias("distance"), F.lit(1).cast("bigint").alias("ways")))
    d = 0
    while not frontier.isEmpty():
        if d > longest:
            raise ValueError("relations lead in a circle, so that ways have no end")
        d += 1
        onward = _onward(frontier, links, step).select(F.col("r.other").alias("sym"), F.col("to").alias("relation"), "root", "ways")
        frontier = cut_lineage(onward.groupBy("sym", "relation", "root").agg(F.sum("ways").alias("ways")).withColumn("distance", F.lit(d)))
        found = found.unionByName(frontier)
    return found


def each_way(rows: DataFrame, block: int = 10_000) -> DataFrame:
    """A row for each of a row's ``ways``, which are counted off by blocks, so that no array is long."""
    blocks = rows.withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(ways - 1) div {block}"))))
    return blocks.withColumn("at", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(block), F.col("ways") - F.col("at") * block)))).drop("at", "ways")


def paths_between(sources: DataFrame, targets: DataFrame, edges: DataFrame, max_nodes: int = MAX_DEPTH) -> DataFrame:
    """src, dst, path, n_nodes: every simple path of at most ``max_nodes`` nodes from a source to a target."""
    here = cut_lineage(sources.select(F.col("sym").alias("src"), F.array("sym").alias("path")).distinct())
    found = None
    ends = targets.select(F.col("sym").alias("dst")).distinct()
    for _ in range(max_nodes - 1):
        longer = here.withColumn("at", F.element_at("path", -1)).join(edges.select(F.col("src").alias("at"), F.col("dst").alias("next")).distinct(), "at")
        here = cut_lineage(longer.where(~F.array_contains("path", F.col("next"))).select("src", F.concat("path", F.array("next")).alias("path")))
        held = here.count()
        if held > PATHS:
            raise ValueError(f"more than {PATHS} paths: ask for fewer nodes or nearer ends, or use a walk with limits")
        if not held:
            break
        hit = here.withColumn("dst", F.element_at("path", -1)).join(ends, "dst", "left_semi")
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        found = here.withColumn("dst", F.lit("")).where("false")
    return found.select("src", "dst", F.array_join("path", ">").alias("path"), F.size("path").alias("n_nodes"))


def path_edges(paths: DataFrame) -> DataFrame:
    """The distinct edges of joined paths."""
    steps = paths.select(F.split("path", ">").alias("p")).select(F.explode(F.arrays_zip(F.slice("p", 1, F.size("p") - 1).alias("src"), F.slice("p", 2, F.size("p")).alias("dst"))).alias("e"))
    return steps.select("e.src", "e.dst").distinct()


def closure(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """root, sym, distance of everything reachable from each root, roots themselves at 0.

    Rounds go on until nothing new is met, so chains of any length are whole and cycles end.
    """
    found = frontier = cut_lineage(roots.select(F.col("sym").alias("root"), "sym", F.lit(0).alias("distance")).distinct())
    d = 0
    while not frontier.isEmpty():
        d += 1
        step = frontier.select("root", F.col("sym").alias("src")).join(edges.select("src", "dst"), "src").select("root", F.col("dst").alias("sym")).distinct()
        frontier = cut_lineage(step.join(found.select("root", "sym"), ["root", "sym"], "left_anti").withColumn("distance", F.lit(d)))
        found = found.unionByName(frontier)
    return found


def families(links: DataFrame) -> DataFrame:
    """sym, first of links (a, b): the smallest symbol that a symbol hangs together with, unless it is that one itself.

    Each round a symbol's link goes on to the smallest one of the symbol it leads to, and its other links lead to its own
    smallest one.  Rounds never add links, and a chain takes about as many as its length has digits, so neither long
    chains nor symbols with many links multiply rows.
    """
    rows = cut_lineage(links.select(F.greatest("a", "b").alias("sym"), F.least("a", "b").alias("first")).where("sym <> first").distinct())

    def lowest(df):
        return df.groupBy("sym").agg(F.min("first").alias("low"))

    while True:
        several = rows.groupBy("sym").agg(F.count("*").alias("n")).where("n > 1")
        further = rows.join(rows.select(F.col("sym").alias("first")), "first", "left_semi")
        if several.isEmpty() and further.isEmpty():
            return rows
        up = rows.join(lowest(rows).withColumnRenamed("sym", "first"), "first", "left").select("sym", F.coalesce("low", "first").alias("first")).distinct()
        own = up.join(lowest(up), "sym").select(F.explode(F.array(F.struct("sym", F.col("low").alias("first")), F.struct(F.col("first").alias("sym"), F.col("low").alias("first")))).alias("r"))
        rows = cut_lineage(own.select("r.*").where("sym <> first").distinct())


def common_ancestor(a: F.Column, b: F.Column) -> F.Column:
    """How many leading segments two segment arrays share; one less if that is all of either."""
    n = F.least(F.size(a), F.size(b))
    same = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (F.get(a, i - 1) == F.get(b, i - 1)), acc + 1).otherwise(acc))
    same = F.when(n > 0, same).otherwise(0)
    return F.when(same == n, F.greatest(same - 1, F.lit(0))).otherwise(same)


def to_dot(edges: list[tuple[str, str, str]], pretty: dict[str, str], coloured: tuple[str, ...] = ()) -> str:
    """Graphviz text of a bounded result: nodes by first sight in edges, callees whose name ends so are coloured."""
    styles = {"inheritance": "dashed", "implementation": "dotted"}
    seen = dict.fromkeys(s for a, b, _ in edges for s in (a, b))
    ids = {s: f"n{i}" for i, s in enumerate(seen)}
    lines = []
    for s in seen:
        label = pretty.get(s, s).replace('"', '\\"')
        fill = ' style=filled fillcolor="lightgray"' if coloured and label.endswith(coloured) else ""
        lines.append(f'  {ids[s]} [label="{label}"{fill}];')
    lines += [f"  {ids[a]} -> {ids[b]} [style={styles.get(k, 'solid')}];" for a, b, k in edges]
    return "digraph {\n" + "\n".join(lines) + "\n}\n"


def to_json(edges: list[tuple[str, str, str]]) -> dict:
    """Sorted nodes and edges; a node without an edge is left out."""
    return {"nodes": sorted({s for a, b, _ in edges for s in (a, b)}), "edges": sorted(({"from": a, "to": b, "kind": k} for a, b, k in edges), key=lambda e: f"{e['from']}-{e['to']}")}


def hierarchy(nodes: list[tuple[str, list[str]]]) -> dict:
    """A tree of segments: {name, sym, children}, chains of single children without a symbol folded into one name."""
    root: dict = {"name": "", "sym": None, "children": {}}
    for sym, parts in nodes:
        at = root
        for p in parts:
            at = at["children"].setdefault(p, {"name": p, "sym": None, "children": {}})
        at["sym"] = sym

    def fold(node: dict) -> dict:
        children = [fold(c) for c in node["children"].values()]
        if len(children) == 1 and node["sym"] is None and node["name"]:
            return {**children[0], "name": f"{node['name']}::{children[0]['name']}"}
        return {"name": node["name"], "sym": node["sym"], "children": children}

    return fold(root)
