"""Forms resolved all at once against one after the other."""

import random
import re

from lodestrata.operators import entities as E


def sequential(forms, definitions):
    """{id: (entity, rule)} by going through the forms in order."""
    words = lambda s: [w for w in re.split("[^a-z0-9]+", s.lower()) if w]
    key = lambda s: "-".join(words(s))
    kept = lambda s: sorted({w for w in words(s) if w not in E.SMALL})
    acronym = lambda s: re.fullmatch("[A-Z]{2,8}", s) is not None
    defs = {}
    for source, short, long in sorted(definitions, key=lambda x: x[2], reverse=True):
        if acronym(short) and not acronym(long):
            defs.setdefault(source, {})[short] = long
    out, alias, by_words, by_key = {}, {}, {}, {}
    for city, i, source, form in sorted((x for x in forms if x[3] is not None), key=lambda x: x[1]):
        form, own = " ".join(form.split()), defs.get(source, {})
        if form not in own and (city, form) in alias:
            out[i] = (alias[city, form], "alias")
            continue
        name = own.get(form, form)
        bag = "-".join(kept(name)) or key(name)
        generic = bool(kept(name)) and all(w in E.GENERIC for w in kept(name))
        if generic:
            entity = by_key.setdefault((city, source, key(name)), i)
            out[i] = (entity, "new" if entity == i else "key")
            continue
        entity, first = by_words.setdefault((city, bag), (i, key(name)))
        out[i] = (entity, "new" if entity == i else "key" if first == key(name) else "words")
        for text in [form, name, *(a for a, long in own.items() if key(long) == key(name))]:
            alias.setdefault((city, text), entity)
    return out


def check(spark, forms, definitions):
    f = spark.createDataFrame(forms, "city long, id long, source string, form string")
    d = spark.createDataFrame(definitions, "source string, acronym string, long string")
    got = {r.id: (r.entity, r.rule) for r in E.resolve(f, d).collect()}
    assert got == sequential(forms, definitions)
    return got


def test_chain(spark):
    """What the first form makes decides the next: acronym before and after its definition, words in another order."""
    definitions = [("s1", "WHO", "World Health Organization"), ("s2", "WHO", "Western Home Office"), ("s3", "XY", "AB")]
    forms = [(1, 1, "s9", "WHO"), (1, 2, "s1", "WHO"), (1, 3, "s9", "World Health Organization"), (1, 4, "s9", "health  organization, World"), (1, 5, "s2", "WHO"), (1, 6, "s9", "WHO"),
             (2, 7, "s1", "World Health Organization"), (2, 8, "s9", "WHO"), (2, 9, "s2", "Western Home Office"), (2, 10, "s9", "who"), (1, 11, "s1", "Ministry of Health"), (1, 12, "s2", "ministry of health"), (1, 13, "s1", "MINISTRY OF HEALTH"), (1, 14, "s3", "XY"), (None, 15, None, "WHO"), (1, 16, "s1", None), (1, 17, "s1", "the of")]
    got = check(spark, forms, definitions)
    assert got[1] == (1, "new") and got[2] == (2, "new") and got[3] == (2, "alias") and got[4] == (2, "words") and got[6] == (1, "alias") and got[8] == (7, "alias")


def test_random_orders(spark):
    r = random.Random(3)
    longs = ["Small Ring", "Ring of Small", "Sea Rail", "Sea Rail Board", "Red Bolt", "Bolt Red", "rail SEA"]
    texts = [*longs, "SR", "RS", "SRB", "RB", "BR", "small ring", "City Council", "council of city"]
    for _ in range(4):
        definitions = list({(f"s{r.randrange(3)}", r.choice(["SR", "RS", "SRB", "RB"]), r.choice(longs)) for _ in range(6)})
        forms = [(r.randrange(2), i, f"s{r.randrange(4)}", r.choice(texts)) for i in range(80)]
        check(spark, forms, definitions)


def test_empty(spark):
    f = spark.createDataFrame([], "city long, id long, source string, form string")
    assert E.resolve(f, spark.createDataFrame([], "source string, acronym string, long string")).count() == 0
