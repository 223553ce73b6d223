"""JSON texts without what is secret, at any depth."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

MASK, CUT = "***", "..."


def _masked(value: Any, secret: re.Pattern[str], most: int) -> Any:
    """The value with those of secret-named keys masked, whatever they hold, and texts over `most` characters cut. No recursion."""
    top = [value]
    todo: list[tuple[Any, Any]] = [(top, 0)]
    while todo:
        holder, at = todo.pop()
        v = holder[at]
        if isinstance(v, dict):
            holder[at] = v = {k: MASK if secret.fullmatch(k) else x for k, x in v.items()}
            todo += [(v, k) for k in v]
        elif isinstance(v, list):
            holder[at] = v = list(v)
            todo += [(v, i) for i in range(len(v))]
        elif isinstance(v, str) and len(v) > most:
            holder[at] = v[:most] + CUT
    return top[0]


def redacted(rows: DataFrame, id_col: str, json_col: str, secret: str, most: int) -> DataFrame:
    """id and the JSON text without secrets, one line each, keys in their order.

    Keys match `secret` as a whole, in any case. A text that isn't JSON might hold anything, so it becomes the mask alone
    (as a JSON string); null stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(secret, re.I)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                try:
                    out.append(None if text is None else json.dumps(_masked(json.loads(text), pattern, most), ensure_ascii=False, separators=(",", ":")))
                except (ValueError, RecursionError):
                    out.append(json.dumps(MASK))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["id", "line"])

    return rows.select(id_col, json_col).mapInArrow(run, f"id {dict(rows.dtypes)[id_col]}, line string")
