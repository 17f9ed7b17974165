"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Equal vectors are one node, so copies cost nothing and give their smallest ids.  Nodes are dealt to shards of bounded size
by digest.  In each shard, greedy beam searches propose neighbours for every node; pruning with a relaxed distance keeps an
edge only if no kept neighbour is much closer to its end, so edges stay diverse; reverse edges are added and pruned alike.
Every query walks the graph of every shard by beam search, and the best of all shards are scored again exactly.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, on either side, and so do
vectors of another length than most; with fewer candidates than asked, all are returned; ties go to the smaller id; repeated
ids are separate rows of one id.  Cosine is taken in double precision on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Distinct vectors in a shard, about: vectors and graph of a shard are a few MB in one task.
SHARD_ROWS = 6000
DEGREE = 48
#: Nodes that a search keeps, while building and while querying.
BUILD_BEAM = 64
QUERY_BEAM = 160
#: Relaxation of pruning: an edge goes if a kept neighbour is this much closer to its end.
ALPHA = 1.2
#: Nodes inserted together, and queries searched together.
BLOCK = 512
QUERY_BLOCK = 2048
#: Query blocks that one task searches in a shard, about.
BLOCKS_A_TASK = 16
#: Parts of a vector's copies that are cut down apart.
SALTS = 16


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def beam_search(vectors: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int, steps: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``beam`` nodes nearest of all that its walk has met, and their cosines, nearest first.

    All queries step together: each opens its nearest unopened node until none is left in its beam.  -1 marks no node.
    """
    m, n = len(queries), len(vectors)
    ids = np.full((m, beam), -1, np.int32)
    near = np.full((m, beam), -np.inf, np.float32)
    opened = np.zeros((m, beam), bool)
    met = np.zeros((m, n), bool)
    ids[:, 0], near[:, 0], met[:, entry] = entry, queries @ vectors[entry], True
    live = np.arange(m)
    for _ in range(steps):
        waiting = ~opened[live] & (ids[live] >= 0)
        live = live[waiting.any(1)]
        if not len(live):
            break
        at = (~opened[live] & (ids[live] >= 0)).argmax(1)  # beams are sorted, so the first is the nearest
        opened[live, at] = True
        around = graph[ids[live, at]]
        fresh = (around >= 0) & ~met[live[:, None], np.maximum(around, 0)]
        met[np.repeat(live, around.shape[1])[fresh.ravel()], around[fresh]] = True
        score = np.full(around.shape, -np.inf, np.float32)
        rows = np.nonzero(fresh)[0]
        score[fresh] = np.einsum("ij,ij->i", queries[live[rows]], vectors[around[fresh]])
        all_near = np.concatenate((near[live], score), 1)
        order = np.argsort(-all_near, 1, kind="stable")[:, :beam]
        near[live] = np.take_along_axis(all_near, order, 1)
        ids[live] = np.where(near[live] > -np.inf, np.take_along_axis(np.concatenate((ids[live], around), 1), order, 1), -1)
        opened[live] = np.take_along_axis(np.concatenate((opened[live], np.zeros(around.shape, bool)), 1), order, 1)
    return ids, near


def robust_prune(vectors: np.ndarray, nodes: np.ndarray, proposed: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node, at most ``degree`` of its proposed neighbours (rows padded with -1), nearest first and diverse."""
    m, c = proposed.shape
    ok = (proposed >= 0) & (proposed != nodes[:, None])
    order = np.argsort(np.where(ok, proposed, len(vectors)), 1, kind="stable")
    proposed, ok = np.take_along_axis(proposed, order, 1), np.take_along_axis(ok, order, 1)
    ok[:, 1:] &= proposed[:, 1:] != proposed[:, :-1]
    there = vectors[np.maximum(proposed, 0)]
    far = np.where(ok, 2 - 2 * np.einsum("ij,ikj->ik", vectors[nodes], there), np.inf)  # squared distances of unit vectors
    order = np.argsort(far, 1, kind="stable")
    proposed, far, there = np.take_along_axis(proposed, order, 1), np.take_along_axis(far, order, 1), np.take_along_axis(there, order[:, :, None], 1)
    alive = np.isfinite(far)
    out = np.full((m, degree), -1, np.int32)
    for k in range(degree):
        has = alive.any(1)
        if not has.any():
            break
        at = alive.argmax(1)
        rows = np.flatnonzero(has)
        out[rows, k] = proposed[rows, at[rows]]
        between = 2 - 2 * np.einsum("ij,ikj->ik", there[rows, at[rows]], there[rows])
        alive[rows] &= alpha * alpha * between > far[rows]
        alive[rows, at[rows]] = False
    return out


def build_graph(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Neighbour lists (padded with -1) and the entry node of unit vectors."""
    n = len(vectors)
    entry = int((vectors @ vectors.mean(0)).argmax())
    graph = np.full((n, degree), -1, np.int32)
    order = np.random.default_rng(n).permutation(n).astype(np.int32)
    order = np.concatenate(([entry], order[order != entry])).astype(np.int32)
    done, size = 1, 8
    while done < n:
        # Blocks grow with the graph, so the first nodes do not all see the entry alone.
        block = order[done : done + min(size, BLOCK)]
        met, _ = beam_search(vectors, graph, entry, vectors[block], beam)
        among = vectors[block] @ vectors[block].T
        np.fill_diagonal(among, -np.inf)
        close = block[np.argsort(-among, 1, kind="stable")[:, : min(8, len(block) - 1)]]
        graph[block] = robust_prune(vectors, block, np.concatenate((met, close), 1), degree, alpha)
        # Reverse edges: each end proposes the block's nodes to itself, and prunes when it has too many.
        src, dst = np.repeat(block, degree), graph[block].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.lexsort((src, dst))
        src, dst = src[by], dst[by]
        ends, first, count = np.unique(dst, return_index=True, return_counts=True)
        extra = np.full((len(ends), int(count.max(initial=0))), -1, np.int32)
        extra[np.repeat(np.arange(len(ends)), count), np.arange(len(dst)) - np.repeat(first, count)] = src
        for a in range(0, len(ends), BLOCK):
            graph[ends[a : a + BLOCK]] = robust_prune(vectors, ends[a : a + BLOCK], np.concatenate((graph[ends[a : a + BLOCK]], extra[a : a + BLOCK]), 1), degree, alpha)
        done, size = done + len(block), size * 2
    return graph, entry


def _usable(df: DataFrame, id_column: str, column: str) -> DataFrame:
    v = F.col(column)
    wrong = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return df.where(F.col(id_column).isNotNull() & v.isNotNull() & ~F.coalesce(wrong, F.lit(False)) & F.coalesce(some, F.lit(False))).select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"))


def build_index(scratch: Scratch, rows: DataFrame, k: int, shard_rows: int | None = None) -> tuple[DataFrame, int]:
    """One row per shard: its distinct vectors (with up to k + 1 smallest ids of each) and their graph."""
    # k + 1 ids of a vector are enough for any query, itself left out.  The window limit is applied before rows are dealt
    # and within salts, so a vector with very many copies never meets in one task.
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("v", salt).orderBy("vec_id"))).where(F.col("r") <= k + 1)
    nodes = scratch.save(few.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids")), "nodes")
    n = nodes.count()
    shards = max(1, -(-n // (shard_rows or SHARD_ROWS)))

    out = pa.schema([("shard", pa.int32()), ("entry", pa.int32()), ("dims", pa.int32()), ("vectors", pa.binary()), ("graph", pa.binary()), ("ids", pa.binary())])

    def build(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        held, first, shard = (pa.Table.from_batches(got).column(i).combine_chunks() for i in range(3))
        ids = np.full((len(held), k + 1), -1, np.int64)
        for i, own in enumerate(first.to_pylist()):
            ids[i, : len(own)] = own
        original = held.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(held), -1)
        order = np.argsort(ids[:, 0], kind="stable")
        original, ids = original[order], ids[order]
        graph, entry = build_graph(unit(original).astype(np.float32))
        row = ([shard[0].as_py()], [entry], [original.shape[1]], [original.tobytes()], [graph.tobytes()], [ids.tobytes()])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, out, strict=True)], schema=out)

    # A partition for each shard, so that graphs are built side by side however small their rows are.
    dealt = nodes.select("v", "ids", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard")).repartitionById(shards, "shard")
    return scratch.save(dealt.mapInArrow(build, "shard int, entry int, dims int, vectors binary, graph binary, ids binary"), "index"), shards


def search(embeddings: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row of ``queries`` among all other rows of ``embeddings``."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "ann")
    common = _usable(embeddings, id_column, column)
    dims = common.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, shards = build_index(scratch, common.where(F.size("v") == dims.d), k)
    asked = _usable(queries, id_column, column).where(F.size("v") == dims.d)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["vec_id"].to_numpy(np.int64)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "query_ids": [ids.tobytes()], "queries": [np.array(pdf["v"].tolist(), np.float64).tobytes()]})

    packed = scratch.save(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(gather, "block int, query_ids binary, queries binary"), "queries")
    # A stated query set against every shard.  Query blocks travel to the shards, which are larger; a shard has a copy for
    # every BLOCKS_A_TASK blocks, so that no task walks a shard for very many queries.
    parts = -(-blocks // BLOCKS_A_TASK)
    asked_of = packed.select("query_ids", "queries", F.pmod("block", F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    copies = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    keys, most = ["shard", "part"], shards * parts
    tiles = copies.repartition(most, *keys).join(asked_of.repartition(most, *keys), keys)
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def walk(batches):
        for batch in batches:
            for t in batch.to_pylist():
                vectors = np.frombuffer(t["vectors"]).reshape(-1, t["dims"])
                graph = np.frombuffer(t["graph"], np.int32).reshape(len(vectors), -1)
                copies = np.frombuffer(t["ids"], np.int64).reshape(len(vectors), -1)
                asked_ids, asked = np.frombuffer(t["query_ids"], np.int64), np.frombuffer(t["queries"]).reshape(-1, t["dims"])
                small = unit(vectors).astype(np.float32)
                for a in range(0, len(asked), BLOCK):
                    q = asked[a : a + BLOCK]
                    found, _ = beam_search(small, graph, t["entry"], unit(q).astype(np.float32), QUERY_BEAM)
                    best = found[:, : max(2 * k, 16)]
                    there = vectors[np.maximum(best, 0)]
                    exact = np.einsum("ij,ikj->ik", q, there) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(there, axis=2))
                    query = np.broadcast_to(asked_ids[a : a + BLOCK, None, None], (*best.shape, copies.shape[1]))
                    ids = np.where(best[:, :, None] >= 0, copies[np.maximum(best, 0)], -1)
                    ok = (ids >= 0) & (ids != query)
                    score = np.broadcast_to(exact[:, :, None], ids.shape)
                    frame = pd.DataFrame({"query_id": query[ok], "vec_id": ids[ok], "score": score[ok]}).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
                    yield pa.RecordBatch.from_pandas(frame.groupby("query_id").head(k), schema=out, preserve_index=False)

    near = tiles.select("entry", "dims", "vectors", "graph", "ids", "query_ids", "queries").mapInArrow(walk, "query_id long, vec_id long, score double")
    # At most k rows per query and shard meet here.
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k)
    merged = near.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("at", "b"))
    return merged.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.far")).alias("score"))
