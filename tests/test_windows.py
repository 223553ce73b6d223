import re

from pyspark.sql import functions as F

from lodestrata.functions import windows as W


def plain(text, budget, overlap):
    pieces, at = [], 0
    for p in re.findall(W.PIECE, text or ""):
        cost = sum(1 if ord(c) < 128 else 4 if "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "가" <= c <= "힯" else 2 for c in p)
        pieces.append((at, at + len(p), cost))
        at += len(p)
    out, b = [], 0
    while b < len(pieces):
        e, used, mark = b, pieces[b][2], None
        while True:
            if mark is None and used >= 4 * (budget - overlap):
                mark = (e, used)
            if e + 1 == len(pieces) or used + pieces[e + 1][2] > 4 * budget:
                break
            e += 1
            used += pieces[e][2]
        out.append((pieces[b][0], pieces[e][1], used))
        if e + 1 == len(pieces):
            break
        b = mark[0] + 1 if mark and used - mark[1] + pieces[e + 1][2] <= 4 * budget else e + 1
    return out


def test_windows(spark):
    texts = ["", None, "   ", "one", "a " * 300, "x" * 500 + " tail", "漢字 かな " * 60 + "end", "héé " * 100 + "\n\n", " lead " + "word " * 7 + "y" * 81 + " z", "a bb ccc dddd " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for budget, overlap in ((20, 5), (20, 0), (3, 1)):
        for r in df.select("id", W.token_windows(F.col("text"), budget, overlap).alias("w")).collect():
            assert [tuple(x) for x in r.w] == plain(texts[r.id], budget, overlap), (texts[r.id], budget)
