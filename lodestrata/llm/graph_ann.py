"""Approximate nearest neighbours on a robust-pruned directed graph, one a shard.

Vectors of one direction are one point, and points are dealt to shards of bounded size by hash. In a shard, points join
a directed graph in batches: a greedy search from the entry point proposes neighbours, and relaxed distance pruning
keeps an edge only if no kept neighbour is `alpha` times closer to the candidate than the point is, so edges stay
diverse; links go back as well and are pruned alike. Queries run a beam search in every shard, and the best of all
shards are scored in double precision on the original vectors.

A shard's points come to its task first and the queries after them in a stream, so a task holds one shard and one
batch of queries, however many there are. Queries meet every shard, so up to `SHARDS` of them shards grow with the
table, from `SHARD_POINTS` points to what `SHARD_BYTES` of vectors hold. Vectors of one direction (equal to 12 places
as unit vectors) are one point, which carries as many ids as a result can hold, the smallest, each with its own vector:
larger ids can't be among the nearest but for rounding, so nothing is lost.

Vectors that are null, zero or hold a null or non-finite component take no part, neither as query nor as candidate;
a vector meets only those of its own length. A query whose candidates are fewer than `k` gets all of them. Repeated
rows (same id and vector) are one candidate. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.store import written

#: Points of a shard at least (where the table has them), shards of that size at most, and the bytes of a shard at most.
SHARD_POINTS, SHARDS, SHARD_BYTES = 8192, 32, 1 << 28
#: Bytes that mark the points visited by a batch of searches.
SEEN_BYTES = 1 << 26
DEGREE = 32
#: Beams of the searches that build the graph and of those that answer.
BUILD_BEAM, QUERY_BEAM = 48, 160
ALPHA = 1.2
BATCH = 512


class Graph:
    """Unit vectors and their out-neighbours (-1: none); nearness is the inner product."""

    def __init__(self, vectors: np.ndarray, *, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA):
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        self.unit = (vectors / norms).astype(np.float32)
        self.degree, self.alpha = degree, alpha
        n = len(self.unit)
        self.out = np.full((n, degree), -1, np.int32)
        mean = self.unit.mean(0)
        self.entry = int(np.argmax(self.unit @ mean))
        order = np.random.default_rng(0).permutation(n)
        order = np.r_[self.entry, order[order != self.entry]]
        at, size = 1, 1
        while at < n:
            batch = order[at : at + size]
            self._insert(batch, beam)
            at += len(batch)
            size = min(BATCH, size * 2)
        for at in range(0, n, BATCH):
            self._insert(order[at : at + BATCH], beam)

    def search(self, queries: np.ndarray, beam: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of many queries at once: ids (-1: none) and similarities, best first."""
        m, n = len(queries), len(self.unit)
        most = max(32, SEEN_BYTES // (n // 8 + 1))
        if m > most:
            parts = [self.search(queries[at : at + most], beam, expand) for at in range(0, m, most)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        ids = np.full((m, beam), -1, np.int64)
        sims = np.full((m, beam), -np.inf, np.float32)
        done = np.ones((m, beam), bool)
        ids[:, 0] = self.entry
        sims[:, 0] = queries @ self.unit[self.entry]
        done[:, 0] = False
        seen = np.zeros((m, n // 8 + 1), np.uint8)  # a bit a point
        seen[:, self.entry >> 3] = 1 << (self.entry & 7)
        live = np.arange(m)
        while len(live):
            open_ = ~done[live]
            pick = np.argsort(~open_, axis=1, kind="stable")[:, :expand]
            valid = np.take_along_axis(open_, pick, 1)
            node = np.where(valid, np.take_along_axis(ids[live], pick, 1), -1)
            mark = done[live]
            np.put_along_axis(mark, pick, True, 1)
            done[live] = mark
            near = np.where(node[:, :, None] >= 0, self.out[node], -1).reshape(len(live), -1)
            rows = np.repeat(np.arange(len(live)), near.shape[1])
            flat = near.reshape(-1)
            ok = flat >= 0
            rows, flat = rows[ok], flat[ok].astype(np.int64)
            fresh = (seen[live[rows], flat >> 3] >> (flat & 7) & 1) == 0
            code = np.unique(rows[fresh] * n + flat[fresh])
            rows, flat = code // n, code % n
            np.bitwise_or.at(seen, (live[rows], flat >> 3), (1 << (flat & 7)).astype(np.uint8))
            got = np.einsum("ij,ij->i", queries[live[rows]], self.unit[flat])
            count = np.bincount(rows, minlength=len(live))
            width = int(count.max(initial=0))
            if width:
                place = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
                new_ids, new_sims = np.full((len(live), width), -1, np.int64), np.full((len(live), width), -np.inf, np.float32)
                new_ids[rows, place], new_sims[rows, place] = flat, got
                all_ids, all_sims = np.c_[ids[live], new_ids], np.c_[sims[live], new_sims]
                all_done = np.c_[done[live], new_ids < 0]
                best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
                ids[live], sims[live], done[live] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_sims, all_done))
            live = live[(~done[live]).any(1)]
        return ids, sims

    def _insert(self, batch: np.ndarray, beam: int) -> None:
        found, _ = self.search(self.unit[batch], beam)
        candidates = np.c_[found, self.out[batch]]
        self.out[batch] = self._prune(batch, candidates)
        source = np.repeat(batch, self.degree)
        target = self.out[batch].reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, start, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(start, count)
        back = np.full((len(nodes), int(count.max(initial=1))), -1, np.int64)
        back[np.repeat(np.arange(len(nodes)), count), place] = source
        both = np.c_[self.out[nodes], back]
        full = (both >= 0).sum(1) > self.degree
        if full.any():
            for at in range(0, int(full.sum()), BATCH):
                part = np.flatnonzero(full)[at : at + BATCH]
                self.out[nodes[part]] = self._prune(nodes[part], both[part])
        easy = np.flatnonzero(~full)
        if len(easy):
            rows = both[easy]
            packed = np.take_along_axis(rows, np.argsort(rows < 0, axis=1, kind="stable"), 1)[:, : self.degree]
            self.out[nodes[easy]] = packed

    def _prune(self, points: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Relaxed pruning of each point's candidates, nearest first, on squared distances."""
        candidates = np.where(candidates == points[:, None], -1, candidates)
        order = np.sort(candidates, axis=1)
        order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
        there = order >= 0
        vectors = self.unit[order]
        own = np.where(there, 2 - 2 * np.einsum("id,icd->ic", self.unit[points], vectors), np.inf)
        kept = np.full((len(points), self.degree), -1, np.int32)
        rows = np.arange(len(points))
        for k in range(self.degree):
            best = own.argmin(1)
            alive = np.isfinite(own[rows, best])
            if not alive.any():
                break
            kept[alive, k] = order[rows[alive], best[alive]]
            between = 2 - 2 * np.einsum("id,icd->ic", vectors[rows, best], vectors)
            own[self.alpha**2 * between <= own] = np.inf
            own[rows, best] = np.inf
        return kept


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (double) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(finite & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull())


_OUT = "query_id long, vec_id long, score double"


def _answer(k: int, beam: int, degree: int, build_beam: int, alpha: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, points, members, graph = None, [], [], None
        for rows in batches:
            for (key, asks), part in rows.groupby(["shard", "asks"], sort=False):
                if key != shard:
                    shard, points, members, graph = key, [], [], None
                if not asks:
                    points.append(np.array(part["v"].tolist(), float))
                    members += [(np.array(ids), np.array(vs.tolist(), float)) for ids, vs in zip(part["ids"], part["vs"])]
                    continue
                if not points:
                    continue
                if graph is None:
                    graph = Graph(np.concatenate(points), degree=degree, beam=build_beam, alpha=alpha)
                    count = np.array([len(ids) for ids, _ in members])
                    start = np.cumsum(count) - count
                    ids, base = np.concatenate([x for x, _ in members]), np.concatenate([x for _, x in members])
                    norms = np.linalg.norm(base, axis=1)
                for at in range(0, len(part), BATCH):
                    asked, queries = part["query_id"].to_numpy()[at : at + BATCH], np.array(part["v"].tolist()[at : at + BATCH], float)
                    size = np.linalg.norm(queries, axis=1)
                    found, _ = graph.search((queries / size[:, None]).astype(np.float32), beam)
                    out: list[pd.DataFrame] = []
                    for q, own, vector, length in zip(found, asked, queries, size):
                        near = q[q >= 0]
                        at_ = np.repeat(start[near] - (np.cumsum(count[near]) - count[near]), count[near]) + np.arange(int(count[near].sum()))
                        at_ = at_[ids[at_] != own]
                        score = (base[at_] * vector).sum(1) / (norms[at_] * length)
                        best = np.lexsort((ids[at_], -score))[:k]
                        out.append(pd.DataFrame({"query_id": own, "vec_id": ids[at_][best], "score": score[best]}))
                    yield pd.concat(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def nearest(vectors: DataFrame, every: int, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", shard_points: int = SHARD_POINTS, degree: int = DEGREE, build_beam: int = BUILD_BEAM, beam: int = QUERY_BEAM, alpha: float = ALPHA) -> DataFrame:
    """The k nearest by cosine of every vector whose id is divisible by `every`: query_id, rank, vec_id, score."""
    rows = usable(vectors, id_col, vector_col)
    # The largest component first, so that no square overflows or vanishes.
    top = F.array_max(F.transform("v", F.abs))
    scaled = F.transform("v", lambda x: x / F.col("top"))
    length = F.sqrt(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x))
    unit = F.transform("u", lambda x: F.round(x / F.col("length"), 12) + F.lit(0.0))
    placed = rows.distinct().withColumn("top", top).withColumn("u", scaled).withColumn("length", length).withColumn("u", unit)
    smallest = Window.partitionBy("u").orderBy("vec_id", F.xxhash64("v"))
    members = placed.withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= k + 1)
    points = members.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("of"))
    points = written(points.select(F.col("u").alias("v"), F.col("of.vec_id").alias("ids"), F.col("of.v").alias("vs"), F.size("u").alias("dim")), "ann-points")
    n, most = F.count(F.lit(1)), F.greatest(F.lit(1), F.floor(F.lit(SHARD_BYTES) / (F.col("dim") * 4)))
    sizes = points.groupBy("dim").agg(F.greatest(F.least(F.ceil(n / shard_points), F.lit(SHARDS)), F.ceil(n / most)).cast("int").alias("shards"))
    sizes = written(sizes, "ann-sizes")
    base = points.join(sizes, "dim").select(F.struct("dim", F.pmod(F.xxhash64("v"), "shards").cast("int").alias("part")).alias("place"), F.lit(False).alias("asks"), F.lit(None).cast("long").alias("query_id"), "v", "ids", "vs")
    asked = rows.where(F.col("vec_id") % every == 0).distinct().withColumn("dim", F.size("v")).join(sizes, "dim")
    asked = asked.select(F.col("dim"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("part"), "vec_id", "v")
    asked = asked.select(F.struct("dim", "part").alias("place"), F.lit(True).alias("asks"), F.col("vec_id").alias("query_id"), "v", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<array<double>>").alias("vs"))
    shards = max(1, sizes.agg(F.sum("shards")).first()[0] or 1)
    both = base.union(asked).select((F.col("place.dim").cast("long") * F.lit(1 << 32) + F.col("place.part")).alias("shard"), "asks", "query_id", "v", "ids", "vs")
    # More tasks than shards, so that few get two; one that does answers them one after another.
    dealt = both.repartition(4 * int(shards), "shard").sortWithinPartitions("shard", "asks", F.xxhash64("v"), "query_id")
    found = dealt.mapInPandas(_answer(k, beam, degree, build_beam, alpha), _OUT)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
