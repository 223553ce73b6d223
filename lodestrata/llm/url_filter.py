"""URL filter by a ratio of character language models, in DataFrame operations only.

Rules (host, path prefix, verdict) judge the urls they fit; the longest wins. Those urls, accepted and rejected,
train two smoothed variable-order Markov models of characters. An url without a rule gets the mean, over its
characters, of log P(character | accepted) - log P(character | rejected), and passes when it isn't below a threshold.

* The models see the url in lower case, with a run of digits as one `0` and other characters than `ALPHABET` as `*`,
  after `ORDER` start marks. Every row counts, however many urls look alike.
* Orders `ORDER` to 0 are mixed by Witten-Bell smoothing, down to a uniform chance: the more often a context was seen,
  and the fewer different characters followed it, the more it counts. Contexts of three characters or more that were
  seen fewer than `PRUNE` times are left out, so the order varies with what the urls support.
* The threshold is fitted on the labelled urls that training leaves out (every fifth, by hash): of 200 classes of the
  score, the cut with the least sum of the two error rates, ties to the lowest.

A null or empty url has score 0. With no labelled url of either class every score is 0 and the method allows. Null,
repeated and odd urls all get their row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.store import written

#: The characters that the models tell apart; `^` starts an url, `*` is any other.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0./:?=&_-#%~+"
SYMBOLS = len(ALPHABET) + 1
#: Longest context, and how often a long one has to be seen.
ORDER, PRUNE = 4, 2
BINS = 200


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case."""
    found = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(hosts: Column, paths: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, null if none. rules: (host, path, verdict)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((hosts == h) | hosts.endswith("." + h)) & paths.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def normalised(url: Column) -> Column:
    text = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "[0-9]+", "0")
    known = "".join("\\" + c if c in "-^]\\[&~#" else c for c in ALPHABET)
    return F.regexp_replace(text, f"(?s)[^{known}]", "*")


def grams(urls: DataFrame) -> DataFrame:
    """One row a character: the context of `ORDER` characters and the character, as one string. urls: key, chars."""
    padded = F.concat(F.lit("^" * ORDER), F.col("chars"))
    places = F.when(F.length("chars") > 0, F.sequence(F.lit(1), F.length("chars"))).otherwise(F.array().cast("array<int>"))
    return urls.select("*", padded.alias("padded"), F.explode(places).alias("at")).withColumn("gram", F.expr(f"substring(padded, at, {ORDER + 1})")).drop("padded", "at")


def models(labelled: DataFrame) -> DataFrame:
    """gram counts of both classes. labelled: chars, good (boolean), n (rows with these characters)."""
    found = grams(labelled)
    yes, no = (F.sum(F.when(side, F.col("n")).otherwise(0)) for side in (F.col("good"), ~F.col("good")))
    return found.groupBy("gram").agg(yes.alias("yes"), no.alias("no"))


def log_ratios(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """gram, delta for each wanted gram (distinct), seen in training or not."""
    total = written(counts, "url-counts")
    last = F.substring("gram", ORDER + 1, 1)
    out, orders = wanted.select("gram", last.alias("x")), range(ORDER, -1, -1)
    for order in orders:
        context = F.substring("gram", ORDER + 1 - order, order)
        level = total.select(context.alias("context"), last.alias("x"), "yes", "no").groupBy("context", "x").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        per = level.groupBy(F.col("context").alias(f"k{order}")).agg(F.sum("yes").alias(f"yes_n{order}"), F.sum("no").alias(f"no_n{order}"), F.count_if(F.col("yes") > 0).alias(f"yes_t{order}"), F.count_if(F.col("no") > 0).alias(f"no_t{order}"))
        if order > 2:
            per = per.where(F.col(f"yes_n{order}") + F.col(f"no_n{order}") >= PRUNE)
        own = level.select(F.col("context").alias(f"g{order}"), F.col("x").alias(f"x{order}"), F.col("yes").alias(f"yes_c{order}"), F.col("no").alias(f"no_c{order}"))
        out = out.withColumn("context", context).join(per, F.col("context") == F.col(f"k{order}"), "left").join(own, (F.col(f"k{order}") == F.col(f"g{order}")) & (F.col("x") == F.col(f"x{order}")), "left")
    chance = {}
    for side in ("yes", "no"):
        p: Column = F.lit(1.0 / SYMBOLS)
        for order in reversed(orders):
            c, n, t = (F.coalesce(F.col(f"{side}_{k}{order}"), F.lit(0)).cast("double") for k in "cnt")
            p = F.when(n > 0, (c + t * p) / (n + t)).otherwise(p)
        chance[side] = p
    return out.select("gram", (F.log(chance["yes"]) - F.log(chance["no"])).alias("delta"))


def scores(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """chars, score of each distinct normalised url. urls: chars (distinct)."""
    # A gram that all urls share is one row a task after the partial count, and one row of the small side of the join.
    found = grams(urls)
    deltas = written(log_ratios(counts, found.select("gram").distinct()), "url-deltas")
    return found.join(deltas, "gram").groupBy("chars").agg(F.avg("delta").alias("score"))


def threshold(scored: DataFrame) -> DataFrame:
    """One row: the cut. scored: score, good, n."""
    edges = scored.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    width = (F.col("high") - F.col("low")) / BINS
    binned = scored.join(F.broadcast(edges)).withColumn("bin", F.when(width > 0, F.least(F.floor((F.col("score") - F.col("low")) / width), F.lit(BINS - 1))).otherwise(0))
    bins = binned.groupBy("bin", "low", "high").agg(F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(~F.col("good"), F.col("n")).otherwise(0)).alias("bad"))
    below, all_ = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    lost = F.coalesce(F.sum("good").over(below), F.lit(0)) / F.greatest(F.sum("good").over(all_), F.lit(1))
    kept = (F.sum("bad").over(all_) - F.coalesce(F.sum("bad").over(below), F.lit(0))) / F.greatest(F.sum("bad").over(all_), F.lit(1))
    cut = F.col("low") + F.col("bin") * width
    return bins.select((lost + kept).alias("errors"), cut.alias("cut")).agg(F.coalesce(F.min_by("cut", F.struct("errors", "cut")), F.lit(0.0)).alias("cut"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row; rules decide first, then the models."""
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host(url).alias("host"), path(url).alias("path"), normalised(url).alias("chars"))
    rows = written(rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)), "url-rows")
    labelled = rows.where("fit IS NOT NULL").groupBy("chars", (F.col("fit.verdict") == "allow").alias("good")).agg(F.count(F.lit(1)).alias("n"))
    held = F.pmod(F.xxhash64("chars"), F.lit(5)) == 0
    counts = models(labelled.where(~held))
    both = labelled.where(~held).agg(F.count_if("good").alias("a"), F.count_if(~F.col("good")).alias("b")).select((F.col("a") * F.col("b") > 0).alias("ready"))
    distinct = rows.select("chars").distinct()
    found = written(scores(distinct, counts).join(F.broadcast(both)).select("chars", F.when(F.col("ready"), F.col("score")).otherwise(0.0).alias("score")), "url-scores")
    cut = threshold(found.join(labelled.where(held), "chars").select("score", "good", "n"))
    judged = rows.join(found, "chars", "left").join(F.broadcast(cut)).withColumn("score", F.coalesce("score", F.lit(0.0)))
    method = F.when(F.col("score") >= F.col("cut"), "allow").otherwise("block")
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), method).alias("verdict"), "score")
