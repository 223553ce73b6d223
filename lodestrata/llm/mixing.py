"""Mixing sources to target weights by Sainte-Laguë apportionment.

Each source's documents form streams of words, one a shard, in a seeded order; a stream is cut into blocks of
`block_words`. The target weights set each source's words. Highest quotients w / (2s + 1) give every source an
integer quota of blocks, and in the same way every shard of a source. A shard takes its quota as whole passes over
its stream and, for the rest, blocks picked by a seeded permutation. A document gets the words of its stretch of the
stream that the picked blocks cover, and never more than `max_epochs` times its size.

Size is the number of `[^\\x20\\x09-\\x0D]+` in the text (null: 0). Sources go by code point, null last; a source
without words has target 0. Repeated rows are documents of their own, taken one after another. An empty table gives
an empty result. Extra columns are ignored by `mix`, kept by `mixed_documents`.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.store import numbered, written

#: Primes above any number of blocks of a shard: multiplying by one permutes the blocks. Fixed values.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
WEIGHTS = (5.0, 2.0, 1.0)
BLOCK_WORDS = 64
SHARD_WORDS = 1_000_000
SHARD_DOCS = 2_000
#: Shards apportioned in one task.
GROUP_SHARDS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fill(sizes: np.ndarray, weights: np.ndarray, total: float, most: float) -> np.ndarray:
    """total shared by weight, each at most `most` times its size, the excess reshared until none is above."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    out, open_ = np.zeros(len(sizes)), sizes > 0
    left = min(total, most * sizes.sum())
    while open_.any():
        share = left * weights / weights[open_].sum()
        over = open_ & (share > most * sizes)
        if not over.any():
            out[open_] = share[open_]
            break
        out[over] = most * sizes[over]
        left -= out[over].sum()
        open_ &= ~over
    return out


def sainte_lague(weights: list[float], seats: int) -> list[int]:
    """Seats by the highest quotients w / (2s + 1), ties to the earlier.

    Rounding the exact shares gives the seats for some number near the wanted one; the quotients then add or take
    back the few that are left, so the work is that of the number of lists, not of seats.
    """
    exact = [Fraction(w) for w in weights]
    total = sum(exact)
    if not total:
        return [0] * len(weights)
    got = [int(w * seats / total + Fraction(1, 2)) for w in exact]
    short = seats - sum(got)
    if short > 0:
        queue = [(-w / (2 * s + 1), i) for i, (w, s) in enumerate(zip(exact, got)) if w > 0]
        heapq.heapify(queue)
        for _ in range(short):
            _, i = heapq.heappop(queue)
            got[i] += 1
            heapq.heappush(queue, (-exact[i] / (2 * got[i] + 1), i))
    elif short < 0:
        queue = [(w / (2 * s - 1), -i) for i, (w, s) in enumerate(zip(exact, got)) if s > 0]
        heapq.heapify(queue)
        for _ in range(-short):
            _, i = heapq.heappop(queue)
            got[-i] -= 1
            if got[-i]:
                heapq.heappush(queue, (exact[-i] / (2 * got[-i] - 1), i))
    return got


def targets(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """source, source_size, target, blocks, shards: one row a source. docs: (source, size).

    The rows of all sources meet in one task; their number is that of the sources, not of the documents.
    """
    sums = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")).coalesce(1)

    def one(parts):
        rows = pd.concat(list(parts))
        if not len(rows):
            return
        null = rows["source"].isna()
        rows = pd.concat([rows[~null].sort_values("source", key=lambda s: s.map(lambda x: x.encode("utf-8", "surrogatepass"))), rows[null]])
        size = rows["source_size"].to_numpy(float)
        weight = np.resize(np.array(weights, float), len(rows))
        target = fill(size, weight, share * size.sum(), max_epochs)
        blocks = sainte_lague(target.tolist(), round(target.sum() / block_words))
        shards = np.maximum(1, np.ceil(np.maximum(size / shard_words, rows["n"].to_numpy() / shard_docs)))
        yield rows.assign(target=target, blocks=blocks, shards=shards.astype(np.int64))[["source", "source_size", "target", "blocks", "shards"]]

    return sums.mapInPandas(one, "source string, source_size long, target double, blocks long, shards long")


def shard_quotas(cells: DataFrame, group_shards: int = GROUP_SHARDS) -> DataFrame:
    """Splits each source's blocks among its shards by their words. cells: source, shard, shard_size, blocks.

    A source's blocks go to groups of shards first and then to the shards of each group, so no task holds more than
    `group_shards` shards, or the groups of one source, however large a source is.
    """
    cells = cells.withColumn("part", F.floor(F.col("shard") / group_shards))
    parts = cells.groupBy("source", "part").agg(F.sum("shard_size").alias("size"), F.first("blocks").alias("blocks"))
    quotas = _apportioned(parts.withColumn("part2", F.lit(0)), ["source", "part2"], "part").drop("part2")
    quotas = quotas.select(F.col("source").alias("of"), F.col("part").alias("at"), F.col("quota").alias("blocks"))
    dealt = cells.drop("blocks").join(quotas, cells["source"].eqNullSafe(quotas["of"]) & (cells["part"] == quotas["at"]))
    found = _apportioned(dealt.select("source", "part", "shard", F.col("shard_size").alias("size"), "blocks"), ["source", "part"], "shard")
    return found.select("source", "shard", F.col("size").alias("shard_size"), "quota")


def _apportioned(rows: DataFrame, group: list[str], item: str) -> DataFrame:
    """group, item, size, quota: the blocks of each group among its items by their sizes."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(item)
        got = sainte_lague(part["size"].astype(float).tolist(), int(part["blocks"].iloc[0]))
        return part.assign(quota=np.array(got, np.int64))[[*group, item, "size", "quota"]]

    return rows.groupBy(*group).applyInPandas(one, f"{group[0]} string, {group[1]} long, {item} long, size long, quota long")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, max_epochs: int = 2, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    return mix_sizes(written(rows, "mix-sizes"), seed=seed, weights=weights, share=share, max_epochs=max_epochs, block_words=block_words, shard_words=shard_words, shard_docs=shard_docs).select("doc_id", "source", "size", "source_size", "target", "taken")


def mix_sizes(rows: DataFrame, *, seed: int = 7, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, max_epochs: int = 2, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, shard_docs: int = SHARD_DOCS, ties: tuple[str, ...] = ("text_hash",)) -> DataFrame:
    """As `mix`, for a written table with doc_id, source, size and text_hash, with the shard and order of each row added.

    Other columns stay; `ties` order rows of equal id and size. The text's hash deals rows of one id (or none) to shards.
    """
    goals = written(targets(rows, weights=weights, share=share, max_epochs=max_epochs, block_words=block_words, shard_words=shard_words, shard_docs=shard_docs), "mix-targets")
    t = goals.withColumnRenamed("source", "of")
    dealt = rows.join(t, rows["source"].eqNullSafe(t["of"])).drop("of")
    dealt = dealt.withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "text_hash")).withColumn("shard", F.pmod(F.xxhash64("order", F.lit(seed + 1)), "shards"))
    cells = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks"))
    quotas = written(shard_quotas(cells), "mix-quotas")
    q = quotas.select(F.col("source").alias("of"), F.col("shard").alias("at"), "shard_size", "quota")
    stream = Window.partitionBy("source", "shard").orderBy("order", "doc_id", "size", *ties).rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("end", F.sum("size").over(stream)).withColumn("begin", F.col("end") - F.col("size"))
    found = placed.join(q, placed["source"].eqNullSafe(q["of"]) & (placed["shard"] == q["at"]))
    prime = F.element_at(F.array(*[F.lit(p) for p in PRIMES]), (F.pmod(F.xxhash64("source", "shard", F.lit(seed)), F.lit(len(PRIMES))) + 1).cast("int"))
    found = found.withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("shard_size") / block_words))).withColumn("prime", prime).withColumn("shift", F.pmod(F.xxhash64(F.lit(seed), "shard", "source"), "n"))
    found = found.withColumn("passes", F.least(F.floor(F.col("quota") / F.col("n")), F.lit(max_epochs))).withColumn("rest", F.when(F.col("passes") < max_epochs, F.pmod("quota", "n")).otherwise(0))
    covered = F.expr(
        f"""CASE WHEN size = 0 OR rest = 0 THEN 0L ELSE
        aggregate(sequence(begin div {block_words}, (end - 1) div {block_words}), 0L, (sum, j) -> sum
          + IF(pmod(j * prime + shift, n) < rest, least(end, (j + 1) * {block_words}) - greatest(begin, j * {block_words}), 0L)) END"""
    )
    extra = ["shard", "order", *(c for c in rows.columns if c not in ("doc_id", "source", "size"))]
    return found.select("doc_id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + covered).alias("taken"), *extra)


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs as the mix takes them, whole; texts are never cut.

    A document that the mix takes r = taken / size times stays floor(r) or ceil(r) times. What the roundings leave is
    carried from each document of a shard to the next, from the smallest to the largest from a seeded start, so the
    words of a source come near its target however long its documents are. One without words is kept once.
    """
    seed = options.get("seed", 7)
    tagged = numbered(docs, "__row")
    rows = written(tagged.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("text_hash"), "__row"), "mix-sizes")
    mixed = mix_sizes(rows, ties=("text_hash", "__row"), **options)
    ratio = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size") * (1 << 20)).cast("long")).otherwise(0)
    start = F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), F.lit(1 << 20))
    line = Window.partitionBy("source", "shard").orderBy("size", "order", "doc_id", "text_hash", "__row").rowsBetween(Window.unboundedPreceding, 0)
    carried = mixed.withColumn("ratio", ratio).withColumn("sum", F.sum("ratio").over(line) + start)
    times = F.shiftright("sum", 20) - F.shiftright(F.col("sum") - F.col("ratio"), 20)
    copies = carried.select("__row", F.when(F.col("size") == 0, 1).otherwise(times).cast("int").alias("__copies")).where("__copies > 0")
    return tagged.join(copies, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop("__row", "__copies", "__copy")
