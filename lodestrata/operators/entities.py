"""Surface forms resolved to entities in the order in which they come: what an earlier form made counts for later ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.steps import kept

#: Words that carry no name, and words of which a name that any place has is made.
SMALL = ["the", "of", "and", "for"]
GENERIC = ["ministry", "department", "health", "city", "council", "office"]


def name_words(name: Column) -> Column:
    return F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: w != "")


def name_key(name: Column) -> Column:
    return F.array_join(name_words(name), "-")


def word_set(name: Column) -> Column:
    """The different significant words in order of the alphabet, or the key where there are none."""
    kept = F.array_sort(F.array_distinct(F.filter(name_words(name), lambda w: ~w.isin(SMALL))))
    return F.when(F.size(kept) > 0, F.array_join(kept, "-")).otherwise(name_key(name))


def is_generic(name: Column) -> Column:
    kept = F.filter(name_words(name), lambda w: ~w.isin(SMALL))
    return (F.size(kept) > 0) & (F.size(F.filter(kept, lambda w: ~w.isin(GENERIC))) == 0)


def is_acronym(form: Column) -> Column:
    return form.rlike("^[A-Z]{2,8}$")


def resolve(forms: DataFrame, definitions: DataFrame) -> DataFrame:
    """city, id, entity, rule of every form. forms: city, id (their order), source, form. definitions: source, acronym, long.

    Each form in turn: an acronym that its source defines stands for the long name; any other form that is known as an
    alias in the city names that alias's entity (rule alias); else the entity with the same word set (key, where its
    first name has the same words in the same order, or words), else a new one, called by the form's id. Unless it was
    an alias, a form then adds aliases, where none of that text exists: itself, its long name, and acronyms that its
    source defines for the same name. A generic name is an entity of its source alone and no alias.

    No form waits for the one before. Which forms make aliases follows from the first of each text: a defined acronym
    always does; any other text does by its first form, if no alias of that text was made before. Long names can only be
    made before by defined acronyms, and acronyms by either, so two rounds of smallest ids settle all. Each step is a
    minimum by city and text, so texts of very many forms are summed up in each task.

    A definition whose long name looks like an acronym, and all but one definition of an acronym in a source (the least
    by name), are ignored. Forms are trimmed, blanks in them collapsed; null ones are left out, a null city or source is
    one like any other. Ids are taken to be different.
    """
    d = definitions.where(is_acronym(F.col("acronym")) & ~is_acronym(F.col("long"))).groupBy("source", "acronym").agg(F.min("long").alias("long"))
    d = d.select(F.col("source").alias("d_source"), "acronym", "long", name_key(F.col("long")).alias("long_key"))
    text = F.trim(F.regexp_replace("form", r"\s+", " "))
    f = forms.where("form IS NOT NULL").select("city", "id", "source", text.alias("form"))
    f = f.join(d.drop("long_key"), f["source"].eqNullSafe(d["d_source"]) & (f["form"] == d["acronym"]), "left")
    f = f.select("city", "id", "source", "form", F.col("long").isNotNull().alias("defined"), F.coalesce("long", "form").alias("name"))
    f = f.select("*", name_key(F.col("name")).alias("key"), word_set(F.col("name")).alias("words"), is_generic(F.col("name")).alias("generic"))
    f = kept(f)
    plain = f.where("NOT generic")

    def adds(makers: DataFrame) -> DataFrame:
        """(city, alias, id): the texts that forms make aliases of."""
        own = makers.select("city", "id", "source", "key", F.explode(F.array_distinct(F.array("form", "name"))).alias("alias"))
        short = makers.join(d, makers["source"].eqNullSafe(d["d_source"]) & (makers["key"] == d["long_key"])).select("city", F.col("acronym").alias("alias"), "id")
        return own.select("city", "alias", "id").union(short).groupBy("city", "alias").agg(F.min("id").alias("id"))

    def made(firsts: DataFrame, before: DataFrame) -> DataFrame:
        """The first forms of texts of which no alias was made before them."""
        b = before.select(F.col("city").alias("b_city"), "alias", F.col("id").alias("b_id"))
        j = firsts.join(b, firsts["city"].eqNullSafe(b["b_city"]) & (firsts["form"] == b["alias"]), "left")
        return j.where("b_id IS NULL OR b_id > id").select(*firsts.columns)

    defined = plain.where("defined")
    columns = ["source", "form", "name", "key", "words"]
    firsts = plain.where("NOT defined").groupBy("city", "form").agg(F.min_by(F.struct("id", "source", "name", "key", "words"), "id").alias("x"))
    firsts = firsts.select("city", "x.id", "x.source", "form", "x.name", "x.key", "x.words")
    sure = adds(defined.select("city", "id", *columns))
    long_ = made(firsts.where(~is_acronym(F.col("form"))), sure)
    after = sure.union(adds(long_)).groupBy("city", "alias").agg(F.min("id").alias("id"))
    short = made(firsts.where(is_acronym(F.col("form"))), after)
    makers = kept(defined.select("city", "id", *columns).union(long_.select("city", "id", *columns)).union(short.select("city", "id", *columns)))
    aliases = adds(makers).groupBy("city", "alias").agg(F.min("id").alias("maker"))

    entities = makers.groupBy("city", "words").agg(F.min("id").alias("entity"), F.min_by("key", "id").alias("first_key"))
    e = entities.select(F.col("city").alias("e_city"), F.col("words").alias("e_words"), "entity", "first_key")
    whose = makers.join(e, makers["city"].eqNullSafe(e["e_city"]) & (makers["words"] == e["e_words"]))
    rule = F.when(F.col("id") == F.col("entity"), "new").when(F.col("key") == F.col("first_key"), "key").otherwise("words")
    by_maker = whose.select("city", "id", "entity", rule.alias("rule"))
    owner = aliases.join(by_maker.select(F.col("id").alias("maker"), "entity"), "maker").select(F.col("city").alias("a_city"), "alias", F.col("entity").alias("a_entity"))
    rest = plain.join(makers.select("id"), "id", "left_anti")
    rest = rest.join(owner, rest["city"].eqNullSafe(owner["a_city"]) & (rest["form"] == owner["alias"])).select("city", "id", F.col("a_entity").alias("entity"), F.lit("alias").alias("rule"))
    w = Window.partitionBy("city", "source", "key")
    own = f.where("generic").withColumn("entity", F.min("id").over(w)).select("city", "id", "entity", F.when(F.col("id") == F.col("entity"), "new").otherwise("key").alias("rule"))
    return by_maker.union(rest).union(own)
