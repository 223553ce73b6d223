"""Document fingerprints by SpotSigs, in DataFrame operations only.

A signature is a common word (the anchor) with the chain of the next two content words after it, common words
skipped, within `REACH` words. A document's fingerprint is the set of its signatures' 64-bit hashes, where a repeated
signature counts as often as it occurs (its nth occurrence is an element of its own); likeness is the Jaccard index of
two such sets. A word with no anchor in the `REACH` words before it (in lists, say) is a signature of its
own, and a text without words is one, so every text that isn't empty has a set.

`near_duplicates` joins all documents: sets are partitioned by length, in classes so wide that a pair at or above
the threshold lies in the same or the next one; within a class they meet on their rarest signatures, are pruned by
their lengths, and the rest compared. Equal sets are one node, so copies make no pairs.

Nulls: a null text is an empty one, with the empty set; two empty sets have likeness 1, an empty and another 0.
Repeated rows get equal fingerprints; rows with a null id come before all others. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.components import components
from lodestrata.llm.store import written

#: Words looked at after an anchor for its chain.
REACH = 8
THRESHOLD = 0.8
#: Sets from which on a signature is common; buckets of signatures that tell tasks which are.
LATE, BUCKETS = 32, 1 << 20
#: Documents in a range of ids, and the largest number of ranges: of cuts (8 MB) and of tasks that a job should have.
#: Beyond 4 billion documents ranges grow, to 400 MB of texts of 2 kB for 200 billion.
RANGE_ROWS, MAX_RANGES = 4000, 1_000_000

#: Common words of English, French, German and Spanish, the anchors.
ANCHORS = "the of and to in a is that for it with as was on are be by this from at or an have not he de la le les et des en un une du que qui est dans pour par sur au avec il pas ne se el los las y del por con para su lo al como más der die und das den von zu mit ist im ein eine dem nicht auf für als es auch sich".split()
_LISTED = ", ".join(f"'{a}'" for a in ANCHORS)


def with_signatures(rows: DataFrame, text_col: str, out: str) -> DataFrame:
    """Adds the set of `text_col`, sorted, as column `out`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = rows.withColumn("__w", F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    # Common words are looked up once a word: in __g they are blank.
    found = found.withColumn("__g", F.expr(f"transform(__w, x -> IF(x IN ({_LISTED}), '', x))"))
    chain = f"xxhash64(x, array_join(slice(filter(slice(__g, i + 2, {REACH}), y -> y <> ''), 1, 2), ' '))"
    alone = f"NOT array_contains(slice(__g, greatest(1, i + 1 - {REACH}), least(i, {REACH})), '')"
    found = found.withColumn("__a", F.expr(f"filter(transform(__w, (x, i) -> IF(get(__g, i) = '', {chain}, IF({alone}, xxhash64(x), NULL))), h -> h IS NOT NULL)"))
    whole = F.when(F.length(text) > 0, F.array(F.xxhash64(text))).otherwise(F.array().cast("array<bigint>"))
    chosen = F.when(F.size("__w") > 0, F.col("__a")).otherwise(whole)
    found = found.withColumn("__s", F.array_sort(chosen))
    # The nth occurrence of a signature is an element of its own. In the sorted list, its number is the distance to the
    # first of its value, found by binary search where the value before is the same.
    steps = ", ".join(str(1 << k) for k in reversed(range(24)))
    first = f"aggregate(array({steps}), 0, (lo, s) -> IF(lo + s <= size(__s) AND get(__s, lo + s - 1) < x, lo + s, lo))"
    numbered = F.expr(f"transform(__s, (x, i) -> IF(i > 0 AND get(__s, i - 1) = x, xxhash64(x, i - {first}), x))")
    return found.withColumn(out, F.array_sort(numbered)).drop("__w", "__g", "__a", "__s")


def digest(sigs: Column) -> Column:
    """The fingerprint as a string: SHA-256 of the sorted set."""
    return F.sha2(F.array_join(sigs.cast("array<string>"), ","), 256)


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard index; 0 without comparing where the lengths alone keep it under `least`, or one set is empty."""
    common = F.size(F.array_intersect(a, b))
    short, long_ = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    return F.when(long_ == 0, F.lit(1.0)).when((short == 0) | (short < long_ * F.lit(least)), F.lit(0.0)).otherwise(common / (short + long_ - common)).cast("double")


def _literal(values: list, kind: str) -> Column:
    """An array as one constant, however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(kind)


def _range_of(ids: Column, cuts: list[int]) -> Column:
    """Number of cuts at or below the id, by binary search in the literal list; 0 for null."""
    if not cuts:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    literal, size = _literal(cuts, "array<bigint>"), len(cuts)
    found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda lo, s: F.when((lo + s <= size) & (F.get(literal, lo + s - 1) <= ids), lo + s).otherwise(lo))
    return F.coalesce(found, F.lit(0))


def ordered_ranges(docs: DataFrame, *, range_rows: int = RANGE_ROWS) -> DataFrame:
    """docs (doc_id, text) in ranges by ascending id, each with the first row of the next range as its last (`ahead`).

    Quantiles of the ids give ranges of about equal size, and the number of cuts is bounded. Each text moves to its
    range once; the first row of a range moves once more, to the range before it (that of the first range to the last).
    """
    ids = docs.select("doc_id")
    rows = ids.count()
    n = min(MAX_RANGES, max(1, math.ceil(rows / range_rows)))
    # Cuts only balance the ranges: an error of a range or two in where they fall changes no result.
    shares = _literal([i / n for i in range(1, n)], "array<double>")
    cuts = ids.agg(F.percentile_approx("doc_id", shares, min(10 * n, 1_000_000))).first()[0] if n > 1 else []
    placed = docs.withColumn("range", _range_of(F.col("doc_id"), sorted(set(cuts or []))))
    # One row a range from here on.
    firsts = placed.groupBy("range").agg(F.min(F.struct("doc_id")).alias("first"))
    line = Window.orderBy("range")
    nexts = firsts.select("range", F.coalesce(F.lead("first").over(line), F.first("first").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("first"))
    nexts = written(nexts.select(F.col("range").alias("to"), F.col("first.doc_id").alias("next_id")), "spot-ranges")
    ahead = docs.join(nexts, docs["doc_id"].eqNullSafe(nexts["next_id"])).groupBy("to").agg(F.min_by(F.struct("doc_id", "text"), F.xxhash64("text")).alias("x"))
    ahead = ahead.select("x.doc_id", "x.text", F.col("to").alias("range"), F.lit(True).alias("ahead"))
    both = placed.select("doc_id", "text", "range", F.lit(False).alias("ahead")).union(ahead)
    return both.withColumn("h", F.xxhash64("text")).repartition(n, "range").sortWithinPartitions("range", "ahead", F.col("doc_id").asc_nulls_first(), "h")


def edited_likeness(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Every text against its edited self (last quarter replaced by the start of the next text) and the next text.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranged = with_signatures(ordered_ranges(rows, range_rows=range_rows), "text", "sigs")
    line = Window.partitionBy("range").orderBy("ahead", F.col("doc_id").asc_nulls_first(), "h")
    met = ranged.select("*", F.lead("text").over(line).alias("next_text"), F.lead("sigs").over(line).alias("next_sigs")).where(~F.col("ahead"))
    met = met.withColumn("n_chars", F.length("text").cast("long")).withColumn("quarter", F.floor(F.col("n_chars") / 4).cast("int"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("quarter")).cast("int")), F.substring("next_text", F.lit(1), F.col("quarter")))
    met = met.select("doc_id", "n_chars", "sigs", "next_sigs", edited.alias("edited"))
    found = with_signatures(met, "edited", "edited_sigs")
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digest(F.col("sigs")).alias("fingerprint"), digest(F.col("edited_sigs")).alias("edited_fingerprint"), likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, fingerprint, component_id (smallest id reachable), n_links (different texts' sets near its own).

    Sets of more common signatures than rare ones still meet only on their prefix: of a set of n, the
    n - ceil(threshold * n) + 1 signatures that come first in an order with rare ones before common ones, one of which
    any near set shares. Any order that all sets use is right; in this one those go last that more than `LATE` sets have
    in their prefix by hash, by their number in each of `BUCKETS` buckets, which every task knows, so that no signature is
    joined with its count. In a length class two sets that
    meet at places pa and pb of their prefixes are compared only if that leaves room for the threshold. Sets move as
    their prefixes under a number of 64 bits; whole ones only if they meet another.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = written(with_signatures(rows, "text", "sigs").select("doc_id", digest(F.col("sigs")).alias("fingerprint"), "sigs").withColumn("node", F.xxhash64("fingerprint")), "spot-prints")
    n = F.size("sigs")
    length = (n - F.ceil(n * F.lit(threshold) - F.lit(1e-9)) + 1).cast("int")
    bucket = lambda sig: F.pmod(sig, F.lit(BUCKETS)).cast("int")
    # Sets are sorted: those of the first signatures by hash tell which are common.
    early = prints.select(F.explode(F.slice("sigs", F.lit(1), length)).alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > LATE)
    common = early.groupBy(bucket(F.col("sig")).alias("bucket")).agg(F.sum("times").alias("times")).toArrow()
    times = [0] * BUCKETS
    for at, t in zip(common.column("bucket").to_pylist(), common.column("times").to_pylist()):
        times[at] = min(t, 2**31 - 1)
    known = _literal(times, "array<int>")
    # What isn't common keeps its order; the others are sorted only where they are needed.
    rare = F.filter("sigs", lambda x: F.get(known, bucket(x)) == 0)
    late = F.array_sort(F.transform(F.filter("sigs", lambda x: F.get(known, bucket(x)) > 0), lambda x: F.struct(F.get(known, bucket(x)).alias("times"), x.alias("sig"))))
    first = F.when(F.size(rare) >= length, rare).otherwise(F.concat(rare, F.transform(late, lambda x: x["sig"])))
    first = F.slice(first, F.lit(1), length)
    sets = prints.select("node", "doc_id", n.alias("n"), first.alias("prefix")).groupBy("node").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.min("doc_id").alias("first"))
    sets = written(sets.withColumn("band", F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / F.lit(-math.log(threshold))).cast("int")), "spot-sets")
    shared = sets.select(F.explode("prefix").alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("sig")
    prefix = sets.select("node", "n", "band", F.posexplode("prefix").alias("at", "sig")).withColumn("place", F.col("at") + 1)
    prefix = written(prefix.join(shared, "sig", "left_semi").select("node", "n", "band", "sig", "place"), "spot-prefix")
    left = prefix.select("sig", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"))
    right = prefix.select("sig", "band", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"))
    # As many as the places leave, if nothing before is shared; the first signature that two near sets share passes.
    room = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + 1 >= F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - 1e-9
    near = left.join(right, ["sig", "band"]).where("a <> b AND na <= nb AND (na < nb OR a < b)").where(F.col("na") >= F.col("nb") * F.lit(threshold) - 1e-9).where(room).select("a", "b").distinct()
    near = written(near, "spot-near")
    wanted = written(near.select(F.col("a").alias("node")).union(near.select("b")).distinct(), "spot-wanted")
    whole = written(prints.select("node", "sigs").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("sigs").alias("sigs")), "spot-whole")
    sa, sb = whole.toDF("a", "sa"), whole.toDF("b", "sb")
    links = written(near.join(sa, "a").join(sb, "b").where(likeness(F.col("sa"), F.col("sb"), threshold) >= threshold - 1e-9).select("a", "b"), "spot-links")
    labels = components(links)
    counts = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    groups = sets.select("node", "first").join(labels, "node", "left").join(counts, "node", "left").select("node", "first", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    least = groups.groupBy("label").agg(F.min("first").alias("component_id"))
    return prints.select("doc_id", "fingerprint", "node").join(groups.join(least, "label").select("node", "component_id", "n_links"), "node").select("doc_id", "fingerprint", "component_id", "n_links")
