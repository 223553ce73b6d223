"""Structured Streaming forms of the event operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

def gapfree_sequences(events: DataFrame, run_col: str, id_col: str, order_col: str) -> DataFrame:
    """run, id, seq: each new content id of a run gets the next number; an id that comes again is never numbered twice.

    Two states: each id of each run by itself, so no list of ids is rewritten or cut, and the next number of each run.
    Ids are kept for ever, as exactly-once asks; a store on disk (RocksDB) holds them. Within an Arrow batch rows are
    numbered by `order_col`; a run's rows are never all in memory.
    """

    def number(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq = state.get[0] if state.exists else 0
        for rows in batches:
            rows = rows.sort_values([order_col, id_col])
            yield pd.DataFrame({run_col: key[0], id_col: rows[id_col].to_numpy(), "seq": range(seq + 1, seq + 1 + len(rows))})
            seq += len(rows)
        state.update((seq,))

    kinds = dict(events.dtypes)
    out = f"{run_col} {kinds[run_col]}, {id_col} {kinds[id_col]}, seq long"
    new = events.select(run_col, id_col, order_col).dropDuplicates([run_col, id_col])
    return new.groupBy(run_col).applyInPandasWithState(number, out, "seq long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time_col: str, kind_col: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per kind and window; events later than the watermark are dropped, closed windows leave the state."""
    w = F.window(time_col, size)
    return events.withWatermark(time_col, late).groupBy(w.alias("w"), kind_col).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind_col, "n")


def first_flights(events: DataFrame, time_col: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """First event of each key within the watermark; repeats are dropped, and old keys leave the state."""
    return events.withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)
