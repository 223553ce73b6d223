"""Rank fusion, anchors and bundles."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reciprocal_rank_fusion(ranked: DataFrame, item: str, rank: str, k: int = 60) -> DataFrame:
    """item, score: sum of 1 / (k + rank) over routes, rounded to 6."""
    return ranked.groupBy(item).agg(F.round(F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col(rank))), 6).alias("score"))


def with_anchors(found: DataFrame, best: DataFrame, slot: str, item: str) -> DataFrame:
    """found plus, for each slot that it doesn't have, the slot's best item, marked as anchored."""
    missing = best.join(found.select(slot).distinct(), slot, "left_anti")
    return found.select(slot, item, F.lit(False).alias("anchored")).union(missing.select(slot, item, F.lit(True).alias("anchored")))


def bundle(df: DataFrame, group: str, order: list[Column], per_group: int, total: int) -> DataFrame:
    """First `total` rows in order with at most `per_group` of each group. Tasks keep `per_group` rows a group."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= per_group).drop("__k").orderBy(*order).limit(total)


def running_budget(df: DataFrame, keys: list[str], order: list[Column], cost: Column, budget: int) -> DataFrame:
    """Rows of each key up to the first that overflows the budget, with `used` so far."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(cost).over(w)).where(F.col("used") <= budget)


def diverse(df: DataFrame, question: str, order: list[Column], slot: str, item: str, pair: str, anchored: str, per_slot: int, total: int) -> DataFrame:
    """question, item, place: the best items with at most `per_slot` a slot and `total` a question, pairs whole or not at all.

    Items come in order; anchored ones are exempt from the slot's bound. An item with a partner (`pair`, else null) brings
    it along, wherever it stands; where both no longer fit, neither comes. A partner that the question lacks doesn't count.

    Items without partner or anchor are taken or their slot (or the whole) is full from then on, so tasks keep the first
    `per_slot` of each slot. The others all stay, each with its partner's slot beside it, and are gone through in order:
    what a task remembers is what was taken, `total` items at most, however many a question has. Orders are taken to end
    in something unique, items to be unique in a question; null questions are left out.
    """
    rows = df.where(F.col(question).isNotNull()).select(F.col(question).alias("question"), F.col(slot).alias("slot"), F.col(item).alias("item"), F.col(pair).alias("pair"), F.coalesce(F.col(anchored), F.lit(False)).alias("anchored"), F.row_number().over(Window.partitionBy(question).orderBy(*order)).alias("at"))
    loose = F.col("pair").isNull() & ~F.col("anchored")
    alone = rows.where(loose).withColumn("k", F.row_number().over(Window.partitionBy("question", "slot").orderBy("at"))).where(F.col("k") <= per_slot).drop("k")
    kept = alone.union(rows.where(~loose))
    other = rows.select(F.col("question").alias("o_question"), F.col("item").alias("o_item"), F.col("slot").alias("o_slot"), F.col("anchored").alias("o_anchored"))
    met = kept.join(other, (F.col("question") == F.col("o_question")) & (F.col("pair") == F.col("o_item")) & (F.col("pair") != F.col("item")), "left")
    dealt = met.select("question", "at", "item", "slot", "anchored", "o_item", "o_slot", "o_anchored").repartition("question").sortWithinPartitions("question", "at")
    kinds = dict(df.dtypes)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, taken, slots = None, [], Counter()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if current is None or r["question"] != current:
                    current, taken, slots = r["question"], [], Counter()
                if len(taken) >= total or r["item"] in taken:
                    continue
                group = [(r["item"], r["slot"], r["anchored"])]
                if r["o_item"] is not None and r["o_item"] not in taken:
                    group.append((r["o_item"], r["o_slot"], r["o_anchored"]))
                bound = Counter(s for _, s, free in group if not free)
                if len(taken) + len(group) <= total and all(slots[s] + n <= per_slot for s, n in bound.items()):
                    out += [(current, i, len(taken) + k) for k, (i, _, _) in enumerate(group, 1)]
                    taken += [i for i, _, _ in group]
                    slots += bound
            types = [batch.schema.field("question").type, batch.schema.field("item").type, pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 3, types)], names=["question", "item", "place"])

    return dealt.mapInArrow(choose, f"question {kinds[question]}, item {kinds[item]}, place int").withColumnRenamed("question", question)
