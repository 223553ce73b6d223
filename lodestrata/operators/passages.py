"""Which texts may hold which quotes, without comparing each with each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a run, and characters of a gram.
RUN, GRAM = 3, 3


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _grams(text: Column, size: int) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(size))))


def _hashed(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.xxhash64(F.lit(kind), v))


def candidates(docs: DataFrame, quotes: DataFrame, text: str, quote: str, doc_id: str, quote_id: str) -> DataFrame:
    """docs joined with the quotes that share their key with them; every pair whose text contains the quote is there.

    A quote has one key. Words inside it stand between blanks in any text that holds it: of five words or more, the key
    is the run of the second to the fourth; of three or four, the second. A shorter one may begin and end within words,
    so its key is its first three characters (or all it has). Texts give each of their own keys once, and only those that
    some quote has; what moves is an id and a key, and a text only to a quote that shares one. Empty quotes and null ones
    are in no pair. Ids are taken to be unique, with other names than each other's columns.
    """
    w = _words(F.col(quote))
    own = quotes.where(F.length(quote) > 0).select(F.col(quote_id).alias("__q"), F.col(quote).alias("__quote"), w.alias("__w"))
    kind = F.when(F.size("__w") >= RUN + 2, "run").when(F.size("__w") >= 3, "word").otherwise(F.concat(F.lit("gram"), F.least(F.length("__quote"), F.lit(GRAM))))
    value = F.when(F.size("__w") >= RUN + 2, F.array_join(F.slice("__w", 2, RUN), " ")).when(F.size("__w") >= 3, F.get("__w", F.lit(1))).otherwise(F.substring("__quote", 1, GRAM))
    asked = own.select("__q", kind.alias("__kind"), value.alias("__value")).select("__q", "__kind", F.xxhash64("__kind", "__value").alias("__key"))
    kinds = {r[0] for r in asked.select("__kind").distinct().collect()}

    held = docs.select(F.col(doc_id).alias("__d"), F.col(text).alias("__text"), _words(F.col(text)).alias("__w"))
    places = F.sequence(F.lit(1), F.greatest(F.size("__w") - RUN + 1, F.lit(1)))
    made = {"run": F.transform(places, lambda i: F.array_join(F.slice("__w", i, RUN), " ")), "word": F.array_distinct("__w")}
    made |= {f"gram{n}": _grams(F.col("__text"), n) for n in range(1, GRAM + 1)}
    # At most five kinds: texts give keys of those alone that the quotes have.
    hashed = [_hashed(k, values) for k, values in made.items() if k in kinds]
    if not hashed:
        return docs.join(quotes, F.lit(False))
    keys = held.select("__d", F.explode(F.array_distinct(F.concat(*hashed))).alias("__key"))
    pairs = keys.join(asked.select("__q", "__key"), "__key").select("__d", "__q").distinct()
    met = docs.join(pairs, F.col(doc_id) == F.col("__d")).drop("__d")
    return met.join(quotes, F.col("__q") == quotes[quote_id]).drop("__q")
