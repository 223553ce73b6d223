import random
import time

import pytest

from lodestrata.llm import line_dedup
from tests.llm.common import empty_docs, odd_docs


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(docs):
    """Compares each line with all earlier ones."""
    earlier, short, out = [], [], []
    for doc_id, text in sorted(docs):
        kept = []
        for line in text.split("\n"):
            words = line.encode().split()
            gone = words in short
            if len(words) >= 5:
                gone = any(abs(len(words) - len(e)) <= 1 and distance(words, e) <= 1 for e in earlier)
                earlier.append(words)
            elif words:
                short.append(words)
            if not gone:
                kept.append(line)
        n = text.count("\n") + 1 - len(kept)
        left = not n or any(x.strip() for x in kept)
        out.append((doc_id, n, "\n".join(kept) if left else None))
    return out


def test_within_one():
    r = random.Random(2)
    for _ in range(3000):
        a, b = ([r.choice("ab") for _ in range(r.randint(0, 5))] for _ in range(2))
        assert line_dedup.within_one(a, b) == (distance(a, b) <= 1)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_planted_lines_against_all_pairs(spark, seed):
    r = random.Random(seed)
    pool = [[f"w{r.randint(0, 40)}" for _ in range(r.randint(3, 9))] for _ in range(12)]
    docs = []
    for i in range(40):
        lines = []
        for _ in range(r.randint(1, 5)):
            words = list(r.choice(pool))
            for _ in range(r.choice([0, 0, 1, 2])):
                at = r.randrange(len(words))
                words[at : at + r.choice([0, 1])] = r.choice([[], [f"n{r.randint(0, 3)}"]])
                words = words or ["x"]
            lines.append(" ".join(words))
        docs.append((i, "\n".join(lines)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, line_dedup.line_report(df).select("doc_id", "removed", "text").collect())) == plain(docs)


def test_documents_against_all_pairs(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    got = sorted(map(tuple, line_dedup.line_report(df).select("doc_id", "removed", "text").collect()))
    assert got == plain(docs)
    kept = line_dedup.dedup_lines(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(i, t) for i, _, t in got if t is not None]


def test_odd_rows(spark):
    docs = odd_docs(spark)
    kept = line_dedup.dedup_lines(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    ids = [r.doc_id for r in rows]
    # 2 differs from 1 by one word and 8 is its copy: both had only that line. Null and blank texts stay.
    assert sorted(i for i in ids if i) == [1, 3, 4, 5, 6, 7] and ids.count(None) == 2
    assert [r.text for r in rows if r.doc_id == 4] == [None]
    assert line_dedup.dedup_lines(empty_docs(spark)).count() == 0
    same = spark.createDataFrame([(1, "one two three four five six")] * 3, "doc_id long, text string")
    assert line_dedup.dedup_lines(same).count() == 3


def test_copies_of_short_lines_go(spark):
    chinese = "\u6211\u4eec\u5728\u6cb3\u8fb9\u770b\u89c1\u4e00\u53ea\u732b"
    docs = spark.createDataFrame([(1, f"Read more\n\n{chinese}\nx1"), (2, f"own\nRead  more\n\n{chinese}"), (3, f"Read less\n{chinese[:4]}\u72d7{chinese[5:]}\nx2\n{chinese[::-1]}"), (4, "x1")], "doc_id long, text string")
    rows = {r.doc_id: (r.removed, r.text) for r in line_dedup.line_report(docs).collect()}
    assert rows == {1: (0, f"Read more\n\n{chinese}\nx1"), 2: (2, "own\n"), 3: (1, f"Read less\nx2\n{chinese[::-1]}"), 4: (1, None)}


def test_long_lines_in_linear_time(spark):
    """A line of 300,000 words with a near twin of each kind, and one of one word over and over."""
    words = [f"w{i * 7919 % 100003}" for i in range(300_000)]
    lines = [words, [*words[:1000], "new", *words[1000:]], [*words[:299_000], "other", *words[299_001:]], words[:150_000] + words[150_001:], ["a"] * 100_000, ["a"] * 100_001, words[::-1]]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id long, text string")
    start = time.time()
    rows = {r.doc_id: r.removed for r in line_dedup.line_report(docs).select("doc_id", "removed").collect()}
    assert rows == {0: 0, 1: 1, 2: 1, 3: 1, 4: 0, 5: 1, 6: 0}
    assert time.time() - start < 120


def test_deletions_equal_the_shorter_line():
    words = [b"a", b"b", b"a", b"c", b"c"]
    keys = line_dedup._deletions(words)
    for i in range(5):
        assert keys[i] == line_dedup._deletions(words[:i] + words[i + 1 :])[-1]
    assert keys[3] == keys[4] and len(set(keys.tolist())) == 5
