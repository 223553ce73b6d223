from pyspark.sql import functions as F

from lodestrata.operators import calls, fusion


def test_calls_with_repair_and_fallback(spark):
    def call(prompt, complaint):
        if prompt == "broken":
            raise TimeoutError("body of a page")
        return prompt.upper() if complaint or prompt != "shy" else "?"

    rows = spark.createDataFrame([(1, "good"), (2, "shy"), (3, "broken"), (4, "bad"), (5, "good"), (6, None)], "k long, p string")
    wrong = lambda a: "not capital" if not a.isupper() or a == "BAD" else None
    got = {r.id: r for r in calls.answered(rows, "k", "p", call, wrong, fallback=lambda p, c: "LAST" if p == "bad" else "x").collect()}
    assert (got[1].answer, got[1].calls) == ("GOOD", 1) and (got[2].answer, got[2].calls, got[2].used_fallback) == ("SHY", 2, False)
    assert got[3].answer is None and got[3].problem == "not capital" and got[3].calls == 3
    assert (got[4].answer, got[4].used_fallback, got[4].calls) == ("LAST", True, 3) and got[5].answer == "GOOD" and got[6].answer is None
    alone = calls.answered(rows.where("k = 3"), "k", "p", call, wrong).collect()
    assert [(r.problem, r.calls) for r in alone] == [("TimeoutError", 2)]


def test_diverse_keeps_pairs_whole(spark):
    rows = [("q", "s1", "a", "b", False, 9), ("q", "s1", "b", "a", False, 1), ("q", "s1", "c", None, False, 8), ("q", "s2", "d", "e", False, 7), ("q", "s2", "e", None, False, 6), ("q", "s1", "f", None, True, 5), ("q", "s3", "g", "h", False, 4), ("q", "s3", "h", "g", False, 3), ("r", "s1", "a", None, False, 1)]
    df = spark.createDataFrame(rows, "q string, slot string, item string, pair string, anchored boolean, score int")
    got = {}
    for r in fusion.diverse(df, "q", [F.col("score").desc()], "slot", "item", "pair", "anchored", 2, 6).collect():
        got.setdefault(r.q, []).append((r.place, r.item))
    # c finds s1 full, f is anchored, g and h don't fit together.
    assert [i for _, i in sorted(got["q"])] == ["a", "b", "d", "e", "f"] and got["r"] == [(1, "a")]


def test_diverse_looks_at_all_items(spark):
    """Thirty items of one slot before ten of the next; a first item whose partner is the last of thirty-nine."""
    schema = "q long, slot int, item long, pair long, anchored boolean"
    rows = [(1, 1, i, None, False) for i in range(30)] + [(1, 2, i, None, False) for i in range(30, 40)]
    rows += [(2, i, i, 38 if i == 0 else None, False) for i in range(39)]
    # More than a double can tell apart.
    rows += [(3, 1, (1 << 53) + 1, (1 << 53) + 2, None), (3, 2, (1 << 53) + 2, None, None), (3, 2, (1 << 53) + 3, 7, None), (None, 1, 1, None, False)]
    df = spark.createDataFrame(rows, schema)
    got = {}
    for r in fusion.diverse(df, "q", [F.col("item")], "slot", "item", "pair", "anchored", 2, 4).collect():
        got.setdefault(r.q, {})[r.place] = r.item
    assert got == {1: {1: 0, 2: 1, 3: 30, 4: 31}, 2: {1: 0, 2: 38, 3: 1, 4: 2}, 3: {1: (1 << 53) + 1, 2: (1 << 53) + 2, 3: (1 << 53) + 3}}
