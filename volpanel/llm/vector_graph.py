"""Nearest neighbours by robust-pruned directed graphs, one per shard.

Vectors are dealt over shards of bounded size by a hash of their id. In a shard, equal vectors share one node.
Nodes are added in batches: a greedy search in the graph so far proposes neighbours, robust pruning keeps an edge
only if no kept neighbour is much closer to the far end (by the factor ``relax``); reverse edges are added, and
pruned alike when they overflow. A query is searched in every shard by beam search and
the shards' answers are merged. Every vector is indexed. The scores are exact distances on the original vectors.

Queries meet the shards in blocks of bounded size (queries x shards), so work grows with the stated number of queries.

Defined cases: vectors that are null, empty, all zero, or hold null or non-finite components take no part, nor
does a query meet vectors of another dimension; of equal vectors the smallest ids win; a query never finds its own
row, but finds copies of it; rows that repeat an id are rows of their own, as candidates and as queries, and are answered under
the same id; vectors of any length are compared whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volpanel.llm.tables import stage, tasks

INDEX_SCHEMA = "dim int, shard bigint, row bigint, vec_id bigint, vector binary, node int, neighbours binary"
#: Queries that one task compares with a shard, and those it advances together.
QUERY_ROWS, TOGETHER = 20_000, 1_000


@dataclass(frozen=True)
class Settings:
    """Edges per node, search width, factor of the relaxed pruning, vectors per shard, nodes added at a time."""

    degree: int = 32
    width: int = 64
    relax: float = 1.2
    shard_rows: int = 2000
    batch: int = 128


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """row (a number of its own), vec_id, vector (doubles), dim of the vectors that take part; written once, so that numbers stay."""
    given = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    some = F.exists("vector", lambda x: x != 0)
    kept = given.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).where(finite & some)
    numbered = kept.withColumns({"dim": F.size("vector"), "row": F.monotonically_increasing_id()})
    return stage(numbered.select("row", "vec_id", "dim", "vector"), "graph-vectors")


def _distances(points: np.ndarray, ids: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Squared distances of rows ``ids`` (q x m, -1 for none) of ``points`` to ``targets`` (q x d)."""
    gap = points[ids] - targets[:, None, :]
    found = np.einsum("qmd,qmd->qm", gap, gap)
    found[ids < 0] = np.inf
    return found


def beam_search(
    points: np.ndarray, edges: np.ndarray, entry: int, targets: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` best nodes met per target, nearest first, and their squared distances; -1 where fewer were met.

    All targets advance together: each expands its nearest open node until none of its best is open.
    """
    q = len(targets)
    ids = np.full((q, width), -1, dtype=np.int64)
    dist = np.full((q, width), np.inf)
    open_ = np.zeros((q, width), dtype=bool)
    ids[:, 0] = entry
    dist[:, 0] = _distances(points, ids[:, :1], targets)[:, 0]
    open_[:, 0] = True
    active = np.arange(q)
    while len(active):
        first = np.argmax(open_[active], axis=1)  # sorted by distance, so the first open one is the nearest
        current = ids[active, first]
        open_[active, first] = False
        near = edges[current].copy()
        near[(near[:, :, None] == ids[active][:, None, :]).any(axis=2)] = -1
        far = _distances(points, near, targets[active])
        far[~(far < dist[active, -1][:, None])] = np.inf
        near[np.isinf(far)] = -1
        all_ids = np.concatenate([ids[active], near], axis=1)
        all_dist = np.concatenate([dist[active], far], axis=1)
        all_open = np.concatenate([open_[active], near >= 0], axis=1)
        order = np.argsort(all_dist, axis=1, kind="stable")[:, :width]
        ids[active] = np.take_along_axis(all_ids, order, axis=1)
        dist[active] = np.take_along_axis(all_dist, order, axis=1)
        open_[active] = np.take_along_axis(all_open, order, axis=1)
        active = active[open_[active].any(axis=1)]
    return ids, dist


def robust_prune(points: np.ndarray, node: int, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Diverse neighbours: nearest first, dropping what a kept one is closer to by the relaxed factor."""
    candidates = np.unique(candidates)
    candidates = candidates[(candidates >= 0) & (candidates != node)]
    gap = points[candidates] - points[node]
    dist = np.einsum("md,md->m", gap, gap)
    order = np.lexsort((candidates, dist))
    candidates, dist = candidates[order], dist[order]
    spread = points[candidates]
    norms = np.einsum("md,md->m", spread, spread)
    between = norms[:, None] + norms[None, :] - 2.0 * (spread @ spread.T)
    alive = np.ones(len(candidates), dtype=bool)
    kept = []
    for i in range(len(candidates)):
        if alive[i]:
            kept.append(i)
            if len(kept) == degree:
                break
            alive &= relax * relax * between[i] > dist
    return candidates[kept]


def build_graph(points: np.ndarray, settings: Settings) -> tuple[np.ndarray, int]:
    """Edges (n x slots, -1 for none) and entry node (the one nearest to the mean) of distinct points."""
    n = len(points)
    slots = settings.degree * 3 // 2  # reverse edges may overflow the degree by half before they are pruned
    edges = np.full((n, slots), -1, dtype=np.int64)
    gap = points - points.mean(axis=0)
    entry = int(np.argmin(np.einsum("nd,nd->n", gap, gap)))
    order = np.random.default_rng(11).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    degree = np.zeros(n, dtype=np.int64)

    def connect(node: int, chosen: np.ndarray) -> None:
        edges[node, : len(chosen)], edges[node, len(chosen) :] = chosen, -1
        degree[node] = len(chosen)

    at = 1
    while at < n:
        nodes = order[at : at + min(settings.batch, at)]
        at += len(nodes)
        met, _ = beam_search(points, edges, entry, points[nodes], settings.width)
        back: dict[int, list[int]] = {}
        for node, found in zip(nodes.tolist(), met):
            chosen = robust_prune(points, node, found, settings.degree, settings.relax)
            connect(node, chosen)
            for other in chosen.tolist():
                back.setdefault(other, []).append(node)
        for other, new in back.items():
            both = np.union1d(edges[other, : degree[other]], new)
            if len(both) > slots:
                both = robust_prune(points, other, both, settings.degree, settings.relax)
            connect(other, both)
    return edges, entry


def build_index(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Graph index of ``usable`` vectors: one row per vector with its node and edges."""
    rows = vectors.select("row", "vec_id", "dim", "vector")
    counts = rows.groupBy("dim").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / settings.shard_rows)).alias("shards"))
    # By id and row, as one id may have many rows.
    dealt = rows.join(counts, "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id", "row"), F.col("shards")).cast("bigint"))

    def graph(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["vec_id", "row"])
        full = np.stack(shard["vector"].to_numpy()).astype(np.float64)
        points, first, node = np.unique(full, axis=0, return_index=True, return_inverse=True)
        edges, entry = build_graph(points, settings)
        node = node.ravel()
        # The entry is node 0, so that the index needs no further table.
        swap = np.arange(len(points))
        swap[[0, entry]] = swap[[entry, 0]]
        renamed = np.where(edges >= 0, swap[edges], -1)[swap].astype(np.int32)
        return pd.DataFrame(
            {
                "dim": shard["dim"].to_numpy(),
                "shard": shard["shard"].to_numpy(),
                "row": shard["row"].to_numpy(),
                "vec_id": shard["vec_id"].to_numpy(),
                "vector": [v.tobytes() for v in full],
                "node": swap[node].astype(np.int32),
                "neighbours": [renamed[k].tobytes() for k in swap[node]],
            }
        )

    # A stated number of partitions: building a graph is work, whatever the few bytes of its vectors suggest.
    shards = dealt.select("dim", "shard", "row", "vec_id", "vector").repartition(tasks(rows.sparkSession), "dim", "shard")
    return stage(shards.groupBy("dim", "shard").applyInPandas(graph, INDEX_SCHEMA), "graph-index")


def search(index: DataFrame, queries: DataFrame, k: int = 10, settings: Settings = Settings(), query_rows: int = QUERY_ROWS) -> DataFrame:
    """The ``k`` nearest found per query (row, vec_id, vector, dim): query_id, rank, vec_id, score."""
    blocks = max(1, -(-queries.count() // query_rows))
    shards = index.select(F.col("dim").alias("dim"), F.col("shard").alias("in_shard")).distinct()
    asked = queries.select(
        F.col("row").alias("query_row"),
        F.col("vec_id").alias("query_id"),
        "dim",
        F.col("vector").alias("target"),
        F.pmod(F.xxhash64("vec_id", "row"), F.lit(blocks)).cast("int").alias("in_block"),
    ).join(shards, "dim")
    parts = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else index.withColumn("block", F.lit(0))

    def look(asked_: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if asked_.empty or part.empty:
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("query_row", "int64"), ("query_id", "int64"), ("vec_id", "int64"), ("score", "float64"))})
        part = part.sort_values(["node", "vec_id", "row"])
        nodes, start = np.unique(part["node"].to_numpy(), return_index=True)
        stop = np.append(start[1:], len(part))
        points = np.stack([np.frombuffer(v) for v in part["vector"].iloc[start]])
        edges = np.stack([np.frombuffer(v, np.int32) for v in part["neighbours"].iloc[start]]).astype(np.int64)
        members, rows = part["vec_id"].to_numpy(), part["row"].to_numpy()
        out = []
        for at in range(0, len(asked_), TOGETHER):
            some = asked_.iloc[at : at + TOGETHER]
            targets = np.stack(some["target"].to_numpy()).astype(np.float64)
            found, _ = beam_search(points, edges, 0, targets, max(settings.width, k + 1))
            for query_row, target, met in zip(some["query_row"], targets, found):
                met = met[met >= 0]
                gap = points[met] - target
                score = np.sqrt(np.einsum("md,md->m", gap, gap))
                for node, value in zip(met, score):
                    ids = members[start[node] : stop[node]][rows[start[node] : stop[node]] != query_row]
                    # Among equal vectors only the smallest ids can be in the answer.
                    out += [(query_row, value, i) for i in ids[:k].tolist()]
        best = pd.DataFrame(_nearest(out, k), columns=["query_row", "score", "vec_id"])
        best["query_id"] = best["query_row"].map(dict(zip(asked_["query_row"], asked_["query_id"])))
        return best[["query_row", "query_id", "vec_id", "score"]]

    answers = (
        asked.groupBy("dim", "in_shard", "in_block")
        .cogroup(parts.groupBy("dim", "shard", "block"))
        .applyInPandas(look, "query_row bigint, query_id bigint, vec_id bigint, score double")
    )
    best = Window.partitionBy("query_row").orderBy("score", "vec_id")
    return answers.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _nearest(rows: list[tuple[int, float, int]], k: int) -> list[tuple[int, float, int]]:
    """The ``k`` best (query row, score, id) per query, ties to the smaller id."""
    best, last, taken = [], None, 0
    for row in sorted(rows):
        taken = taken + 1 if row[0] == last else 1
        last = row[0]
        if taken <= k:
            best.append(row)
    return best


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10,
    settings: Settings = Settings(),
) -> DataFrame:
    """Index all usable vectors and search those for which ``is_query`` (over ``vec_id``) holds."""
    given = usable(vectors, vec_id, vector)
    index = build_index(given, settings)
    found = search(index, given.where(is_query), k, settings)
    return found.select("query_id", "rank", "vec_id", "score")
