import random

from pyspark.sql import functions as F

from lodestrata.functions import values as V
from lodestrata.operators import similar


def test_against_all_pairs(spark):
    r = random.Random(6)
    stems = ["north harbour", "south harbour", "harbour", "green lane", "lane"]
    names = sorted({"".join(c if r.random() > 0.1 else r.choice("abcxyz ") for c in r.choice(stems)) for _ in range(120)}) + [None, "--", "a"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, name string")
    grams = {x.name: set(x.g) for x in df.where("name IS NOT NULL").select("name", V.trigrams(F.col("name")).alias("g")).collect()}
    for percent in (30, 50, 80):
        asked = df.where("id % 4 = 0 OR name IS NULL")
        got = {(x.asked, x.name): x.similarity for x in similar.similar(df, asked, "name", percent).collect()}
        want = {(a, b): round(len(grams[a] & grams[b]) / len(grams[a] | grams[b]), 6) for a in names[::4] if a and grams.get(a) for b in names if b and b != a and grams[b] and 100 * len(grams[a] & grams[b]) >= percent * len(grams[a] | grams[b])}
        assert got == want and (want or percent == 80)
