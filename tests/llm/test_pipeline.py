import random
from collections import Counter

import corpus_pipeline
from lodestrata.llm import queries, simhash
from lodestrata.llm.store import written
from tests.llm.common import empty_docs, odd_docs


def test_stages_on_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, data), "test-stage")
        assert docs.columns == names, name
        assert docs.where("n_chars <> length(text)").count() == 0
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0
    assert max(Counter(r.doc_id for r in docs.collect()).values()) <= 2
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r.doc_id for r in docs.collect())


def test_run_and_reruns(spark, data):
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    first, second = (Counter(map(key, corpus_pipeline.run(spark, data).collect())) for _ in range(2))
    assert first == second


def test_stages_on_an_empty_table(spark, data):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty_docs(spark), data).count() == 0


def test_stages_in_sequence_on_odd_rows(spark, data):
    """Nulls in every column, blank and long texts, repeated rows and clashing columns, through all stages."""
    docs = odd_docs(spark)
    names, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, data), "odd-stage")
        assert docs.columns == names, name
        sizes.append(docs.count())
    # No label is of these documents' ids alone, so none need be rejected; copies, near copies and repeats are gone.
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0
    kept = docs.collect()
    assert any(r.text is None or not r.text.strip() for r in kept)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    assert sum(r.piece == 0 for r in rows) == len(kept) and all(r.length <= 2048 for r in rows)


def near_kept(docs):
    """Smallest ids of the groups that five-word Jaccard >= 0.8 connects, by comparing every pair."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").encode().lower().split()) else set() for i, t in docs}
    group = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and group[a] != group[b] and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    return sorted(set(group.values()))


def test_near_dedup_against_all_pairs(spark, data):
    r, docs = random.Random(4), []
    for base in range(30):
        words = [f"w{r.randrange(3000)}" for _ in range(r.choice([3, 5, 9, 30, 80, 200]))]
        for _ in range(r.randint(1, 8)):
            own = list(words)
            for _ in range(r.choice([0, 1, 2, 3])):
                own[r.randrange(len(own))] = f"n{r.randrange(50)}"
            docs.append((len(docs), " ".join(own)))
    docs += [(len(docs), ""), (len(docs) + 1, None), (len(docs) + 2, "A b c d e f"), (len(docs) + 3, "a b c d e f")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    kept = sorted(x.doc_id for x in corpus_pipeline.simhash_stage(spark, table, data).collect())
    assert kept == near_kept(docs)
    passage = " ".join(f"p{k}" for k in range(40))
    shared = docs + [(len(docs) + k, " ".join(f"q{r.randrange(900)}" for _ in range(30)) + f" {passage}" + " x" * (k % 3)) for k in range(20)]
    table = spark.createDataFrame(shared, "doc_id long, text string")
    assert sorted(x.doc_id for x in simhash.dedup(table, shingle=5, percent=80, cross=0).collect()) == near_kept(shared)


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries() if n.startswith("op")) == list(range(1, 14))


def test_companion_queries_against_their_sql(spark, data):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        found = queries.queries()[name](spark, data)
        wanted = db.execute(sql)
        names = [c[0] for c in wanted.description]
        key = lambda r: tuple(map(str, r))
        assert sorted(found.columns) == sorted(names)
        assert sorted(map(tuple, found.select(*names).collect()), key=key) == sorted(wanted.fetchall(), key=key), name
