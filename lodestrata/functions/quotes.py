"""Quote alignment: a quote is found in a text through a plain form of both, and mapped back to exact offsets."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Typographic characters and what they are compared as.
PLAIN = {"‘": "'", "’": "'", "‚": "'", "“": '"', "”": '"', "„": '"', "«": '"', "»": '"', "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "…": "..."}

#: What a text is made of: a hyphen that divides a word at a line's end, a list mark at a line's start, invisible signs,
#: blanks with bullets and private signs, and letters with their marks.
_PIECES = regex.compile(
    r"(?P<gone>(?<=\p{L})-[ \t]*\n[ \t]*(?=\p{Ll})|[­​‌‍⁠﻿]+)|(?P<blank>(?m:^)[ \t]*[-*][ \t]+|[\s\p{Co}•‣●▪◦·]+)|(?P<letter>\P{M}\p{M}*|\p{M}+)"
)
_NUMBER = regex.compile(r"\d+(?:[.,]\d+)*")


@dataclass(frozen=True)
class Bounds:
    """Words of a quote: under `unique` it must stand only once in the text, over `most` it is refused."""

    unique: int = 4
    most: int = 400


class Flat:
    """The plain form of a text, and for each of its characters the start and end of what it stands for."""

    def __init__(self, text: str):
        self.start: list[int] = []
        self.end: list[int] = []
        out: list[str] = []
        for m in _PIECES.finditer(text):
            if m["gone"] is not None:
                continue
            form = " " if m["blank"] is not None else PLAIN.get(m[0]) or unicodedata.normalize("NFKC", m[0])
            for x in " ".join(form.split()) or " ":
                if x == " " and out and out[-1] == " ":
                    self.end[-1] = m.end()
                    continue
                out.append(x)
                self.start.append(m.start())
                self.end.append(m.end())
        self.text = "".join(out)

    def places(self, quote: str) -> list[int]:
        """Where a plain quote begins: with its first letter as it is, else with the other case."""
        first, rest = quote[0], regex.escape(quote[1:])
        found = [(m.start(), m[0]) for m in regex.finditer(f"(?={rest_of(first)}{rest}){rest_of(first)}", self.text)]
        same = [at for at, x in found if x == first]
        return same or [at for at, _ in found]


def rest_of(letter: str) -> str:
    """A pattern for a letter in either case."""
    return "(?:" + "|".join(dict.fromkeys((regex.escape(letter), regex.escape(letter.swapcase())))) + ")"


def stands_in(value: str, quote: str) -> bool:
    """Whether every number of a value stands whole in the quote."""
    return set(_NUMBER.findall(value)) <= set(_NUMBER.findall(quote))


def match(text: Flat, quote: str, value: str | None = None, bounds: Bounds = Bounds()) -> tuple[int, int] | str:
    """The half-open span of a quote in a text, or why there is none."""
    wanted = Flat(quote).text.strip()
    n = len(wanted.split())
    if not 0 < n <= bounds.most:
        return "quote_length"
    places = text.places(wanted)
    if not places:
        return "quote_not_found"
    if n < bounds.unique and len(places) > 1:
        return "quote_not_unique"
    if value is not None and not stands_in(value, wanted):
        return "value_not_in_quote"
    return text.start[places[0]], text.end[places[0] + len(wanted) - 1]


def align(text: str, quote: str, short: int = 4) -> tuple[int, int] | None:
    """The span alone, null for any reason; quotes of fewer than `short` words must be unique."""
    found = match(Flat(text), quote, bounds=Bounds(unique=short))
    return None if isinstance(found, str) else found


def align_pairs(pairs: DataFrame) -> DataFrame:
    """pairs (doc_id, item_id, text, quote, value) to doc_id, item_id, span_start, span_end, drop_reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, flat, found = None, Flat(""), []
            for text, quote, value in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                if text != last:
                    last, flat = text, Flat(text or "")
                found.append(match(flat, quote or "", value))
            spans = [pa.array([None if isinstance(s, str) else s[k] for s in found], pa.int64()) for k in (0, 1)]
            reasons = pa.array([s if isinstance(s, str) else None for s in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *spans, reasons], names=["doc_id", "item_id", "span_start", "span_end", "drop_reason"])

    return pairs.mapInArrow(run, "doc_id long, item_id long, span_start long, span_end long, drop_reason string")
