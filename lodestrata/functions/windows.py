"""Overlapping windows of a text by a budget of tokens, cut between words, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word with the white space before it, or white space at the end of a text.
PIECE = r"\s*\S+|\s+$"


def quarters(text: Column) -> Column:
    """Tokens of a text in quarters: one for an ASCII character, four for one of a wide script, two for others."""
    wide = F.length(F.regexp_replace(text, r"[^\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}]", ""))
    ascii_ = F.length(F.regexp_replace(text, r"[^\x{00}-\x{7F}]", ""))
    return (2 * F.length(text) - ascii_ + 2 * wide).cast("int")


def token_windows(text: Column, budget: int, overlap: int) -> Column:
    """Windows (begin, end, quarters) of a text: half-open spans of characters, each of `budget` tokens at most.

    A window takes words while they fit. The next one begins behind the first word with which the window held `budget -
    overlap` tokens or more, so what two share is `overlap` tokens at most; where the next word wouldn't fit behind that,
    it begins at that word. A word over the budget is a window of its own. Windows cover the text; an empty or null one
    has none. One fold over the words, with the last window alone in hand.
    """
    most, enough = 4 * budget, 4 * (budget - overlap)
    none = F.array().cast("array<struct<begin:int,end:int,quarters:int>>")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("used"), F.lit(0).alias("begin"), F.lit(-1).alias("mark"), F.lit(0).alias("marked"), none.alias("out"))
    pieces = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0)), lambda p: F.struct(F.length(p).alias("size"), quarters(p).alias("cost")))

    def step(s: Column, p: Column) -> Column:
        full = (s["used"] > 0) & (s["used"] + p["cost"] > most)
        shares = (s["mark"] >= 0) & (s["used"] - s["marked"] + p["cost"] <= most)
        begin = F.when(~full, s["begin"]).when(shares, s["mark"]).otherwise(s["at"])
        used = p["cost"] + F.when(~full, s["used"]).when(shares, s["used"] - s["marked"]).otherwise(0)
        open_ = F.when(full, F.lit(-1)).otherwise(s["mark"])
        marks = (open_ < 0) & (used >= enough)
        out = F.when(full, F.concat(s["out"], F.array(F.struct(s["begin"].alias("begin"), s["at"].alias("end"), s["used"].alias("quarters"))))).otherwise(s["out"])
        at = s["at"] + p["size"]
        return F.struct(at.alias("at"), used.alias("used"), begin.alias("begin"), F.when(marks, at).otherwise(open_).alias("mark"), F.when(marks, used).otherwise(s["marked"]).alias("marked"), out.alias("out"))

    def finish(s: Column) -> Column:
        last = F.array(F.struct(s["begin"].alias("begin"), s["at"].alias("end"), s["used"].alias("quarters")))
        return F.when(s["at"] > 0, F.concat(s["out"], last)).otherwise(s["out"])

    return F.aggregate(pieces, start, step, finish)
