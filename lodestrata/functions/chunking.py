"""Sentence chunks with exact offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Ends of sentences, among them the full-width ones.
_END = re.compile(r"[.!?]+[\"')\]]*\s+|\n+|[。！？]+")


def sentences(text: str) -> list[tuple[int, int]]:
    """Half-open spans that together cover the text."""
    out, at = [], 0
    for m in _END.finditer(text):
        out.append((at, m.end()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def chunks(text: str, budget: int = 1000, overlap: int = 1) -> list[tuple[int, int]]:
    """Spans of whole sentences up to `budget` characters; each starts `overlap` sentences before the last one's end.

    A sentence longer than the budget is cut at white space, or inside a word if there is none.
    """
    parts: list[tuple[int, int]] = []
    for a, b in sentences(text):
        while b - a > budget:
            cut = max(text.rfind(" ", a + 1, a + budget), text.rfind("\n", a + 1, a + budget)) + 1 or a + budget
            parts.append((a, cut))
            a = cut
        parts.append((a, b))
    out, i = [], 0
    while i < len(parts):
        j = i + 1
        while j < len(parts) and parts[j][1] - parts[i][0] <= budget:
            j += 1
        out.append((parts[i][0], parts[j - 1][1]))
        if j >= len(parts):
            break
        i = max(j - overlap, i + 1)
    return out


def chunk_documents(docs: DataFrame, budget: int = 1000, overlap: int = 1) -> DataFrame:
    """docs (doc_id, text) to doc_id, chunk_no, span_start, span_end. One pass over Arrow batches, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n, a, b) for i, t in zip(batch.column(0).to_pylist(), batch.column(1)) for n, (a, b) in enumerate(chunks(t.as_py() or "", budget, overlap))]
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[1:])], names=["doc_id", "chunk_no", "span_start", "span_end"])

    return docs.mapInArrow(run, "doc_id long, chunk_no int, span_start int, span_end int")
