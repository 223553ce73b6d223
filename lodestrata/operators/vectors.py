"""Exact nearest vectors of a query set: blocks of vectors against a stream of queries, as matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block, and queries multiplied with it at a time.
BLOCK, BATCH = 16_384, 1_000


def _answers(k: int):
    def unit(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        v = np.array(rows["v"].tolist(), float)
        return v, np.sqrt((v * v).sum(1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, parts, base = None, [], None
        for rows in batches:
            for (key, asks), part in rows.groupby(["block", "asks"], sort=False):
                if key != block:
                    block, parts, base = key, [], None
                if not asks:
                    parts.append(part)
                    continue
                if not parts:
                    continue
                if base is None:
                    held = pd.concat(parts)
                    base, norms, ids, labels = *unit(held), held["id"].to_numpy(), held["label"].to_numpy()
                for at in range(0, len(part), BATCH):
                    some = part.iloc[at : at + BATCH]
                    q, q_norms = unit(some)
                    both = np.outer(q_norms, norms)
                    score = np.round(np.divide(q @ base.T, both, out=np.zeros_like(both), where=both > 0), 6)
                    asked = some["id"].to_numpy()
                    score[asked[:, None] == ids[None, :]] = -np.inf
                    least = np.partition(score, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))]
                    i, j = np.nonzero(score >= np.maximum(least, -2)[:, None])
                    order = np.lexsort((ids[j], -score[i, j], i))
                    i, j = i[order], j[order]
                    first = np.searchsorted(i, i)
                    kept = np.arange(len(i)) - first < k
                    i, j = i[kept], j[kept]
                    yield pd.DataFrame({"query_id": asked[i], "vec_id": ids[j], "label": labels[j], "score": score[i, j]})

    return run


def nearest(vectors: DataFrame, every: int, k: int) -> DataFrame:
    """query_id, vec_id, label, score, rank: the k nearest by cosine of each vector whose id is divisible by `every`.

    vectors: vec_id, label, embedding. Every query meets every block, and a block answers with its k best, so what is
    shuffled are the vectors once, the queries once a block, and k rows a query and block.
    """
    rows = vectors.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("v")).where("v IS NOT NULL AND size(v) > 0")
    blocks = max(1, -(-rows.count() // BLOCK))
    base = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.lit(False).alias("asks"), "id", "label", "v")
    asked = rows.where(F.col("id") % every == 0).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(True).alias("asks"), "id", "label", "v")
    dealt = base.union(asked).repartition(2 * blocks, "block").sortWithinPartitions("block", "asks", "id")
    found = dealt.mapInPandas(_answers(k), "query_id long, vec_id long, label long, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
