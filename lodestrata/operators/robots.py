"""Robots files: lines to groups, agents and rules, and what they say of urls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def product_token(agent: str) -> str:
    """The name of an agent without its version."""
    words = agent.replace("/", " ").split()
    return words[0].lower() if words else ""


def availability(status: Column) -> Column:
    """parsed (2xx), unavailable (4xx, so all is allowed) or unreachable (429, others, none: nothing is)."""
    return F.when(status.between(200, 299), "parsed").when(status.between(400, 499) & (status != 429), "unavailable").otherwise("unreachable")


def lines(files: DataFrame) -> DataFrame:
    """(site, at, field, value, group) of the lines that say something. files: site, body.

    A run of user-agent lines begins a group, and what follows up to the next run is in it; lines before the first have
    group 0. The number of a group is that of runs begun so far, which is all that is carried from line to line.
    """
    rows = files.select("site", F.posexplode(F.split("body", "\r\n|\r|\n")).alias("at", "line"))
    rows = rows.withColumn("line", F.trim(F.substring_index("line", "#", 1))).where(F.contains("line", F.lit(":")))
    colon = F.instr("line", ":")
    blank = r"^\s+|\s+$"
    rows = rows.select("site", "at", F.lower(F.regexp_replace(F.substring("line", F.lit(1), colon - 1), blank, "")).alias("field"), F.regexp_replace(F.expr("substring(line, instr(line, ':') + 1)"), blank, "").alias("value"))
    w = Window.partitionBy("site").orderBy("at")
    agent = F.col("field") == "user-agent"
    begins = agent & ~F.coalesce(F.lag(agent).over(w), F.lit(False))
    return rows.withColumn("begins", begins.cast("int")).withColumn("group", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("begins")


def rules_for(files: DataFrame, agent: str) -> DataFrame:
    """(site, rules): for each site the rules of all groups that name the agent, else of all for `*`, one array each.

    A rule is its weight (length without wildcards), whether it allows, and a pattern for paths. Empty rules say nothing.
    """
    said = lines(files)
    token = product_token(agent)
    named = said.where("group > 0 AND field = 'user-agent'").select("site", "group", F.when(F.lower("value") == token, 2).when(F.col("value") == "*", 1).alias("fit")).where("fit IS NOT NULL")
    fits = named.groupBy("site", "group").agg(F.max("fit").alias("fit"))
    best = fits.groupBy("site").agg(F.max("fit").alias("fit"))
    rules = said.where("group > 0 AND field IN ('allow', 'disallow') AND value <> ''").join(fits.join(best, ["site", "fit"]), ["site", "group"])
    bare = F.regexp_replace("value", r"\$+$", "")
    pattern = F.concat(F.lit("(?s)^"), F.replace(F.regexp_replace(bare, r"([\\.\[\]{}()+?^$|])", r"\\$1"), F.lit("*"), F.lit(".*")), F.when(F.endswith("value", F.lit("$")), F.lit(r"\z")).otherwise(F.lit("")))
    weight = F.length(F.replace(bare, F.lit("*"), F.lit("")))
    return rules.groupBy("site").agg(F.collect_set(F.struct(weight.alias("weight"), (F.col("field") == "allow").alias("allows"), pattern.alias("pattern"))).alias("rules"))


def decisions(urls: DataFrame, files: DataFrame, agent: str) -> DataFrame:
    """urls (id, site, path) with `why` (parsed, unavailable, unreachable) and `allowed`. files: site, status, body.

    The rule of the greatest weight that fits a path decides, allow before disallow; none allows. A url's rules come as
    one array of its site, so urls of a site with very many aren't multiplied by its rules. A site without a row counts
    as unreachable. Rows of a site are taken to be one.
    """
    state = files.select("site", availability(F.col("status")).alias("why"))
    rules = rules_for(files.join(state.where("why = 'parsed'").select("site"), "site", "left_semi").select("site", "body"), agent)
    j = urls.join(state, "site", "left").join(rules, "site", "left")
    fitting = F.filter(F.coalesce("rules", F.array().cast("array<struct<weight:int,allows:boolean,pattern:string>>")), lambda r: F.rlike(F.col("path"), r["pattern"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(r["weight"], r["allows"])))["allows"]
    why = F.coalesce("why", F.lit("unreachable"))
    return j.select(*urls.columns, why.alias("why"), F.when(why == "parsed", F.coalesce(best, F.lit(True))).otherwise(why == "unavailable").alias("allowed"))
