import numpy as np

from lodestrata.llm import quality
from tests.llm.common import empty_docs, odd_docs


def test_held_out_accuracy(spark, data):
    data = data.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.quality for r in labels.collect()}
    train = labels.where("doc_id % 3 <> 0")
    rows = {r.doc_id: r for r in quality.scores(docs, quality.fit(docs, train)).collect()}
    test = [i for i in known if i % 3 == 0 and i in rows]
    good = [rows[i].accepted for i in test if known[i] == 1]
    bad = [not rows[i].accepted for i in test if known[i] == 0]
    assert np.mean(good) >= 0.97 and np.mean(bad) >= 0.9


def test_accepted_and_scores_agree_and_reruns_too(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    model, again = quality.fit(docs, labels), quality.fit(docs.repartition(4), labels)
    scored = {r.doc_id: r for r in quality.scores(docs, model).collect()}
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in scored.items() if r.accepted)
    other = {r.doc_id: r for r in quality.scores(docs, again).collect()}
    assert all(abs(scored[i].probability - other[i].probability) < 1e-6 for i in scored)


def test_cotraining_teaches_the_weaker_view():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 2000).astype(float)
    text, meta = y[:, None] + rng.normal(0, 0.2, (2000, 1)), y[:, None] + rng.normal(0, 0.6, (2000, 1))
    pool = [np.r_[t, m].astype("<f4").tobytes() for t, m in zip(text[40:], meta[40:])]
    model = quality.cotrain(text[:40], meta[:40], y[:40], quality.from_rows(pool))
    assert np.mean((model.probability(text[40:], meta[40:]) > 0.5) == y[40:]) > 0.95


def test_odd_rows(spark):
    docs = odd_docs(spark)
    none = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {(r.probability, r.accepted) for r in quality.scores(docs, none).collect()} == {(0.5, True)}
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, 0), (3, None, 0), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.accepted(docs, quality.fit(docs, labels)).count() == 11
    assert quality.scores(empty_docs(spark), quality.fit(empty_docs(spark), labels)).count() == 0


def test_all_unlabelled_rows_are_scored_as_in_plain_python(spark, data, monkeypatch):
    """Against a plain version that ranks every unlabelled row in one list; the table has far more rows than a round teaches."""
    docs, labels = (spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    monkeypatch.setattr(quality, "GROUP_TASKS", 2)
    table = quality.prepared(docs.repartition(9), labels)
    model = quality.fit_prepared(table, per_round=0.1)
    rows = table.collect()
    pool = [bytes(r.x) for r in rows if not r.labelled]

    def plain(asked):
        t, m = quality.split(pool, asked.width)
        for k, view in enumerate((t, m)):
            p = 1 / (1 + np.exp(-asked.learned[k].margin(view)))
            for label, score in ((1, p), (0, 1 - p)):
                found = {x: s for x, s in zip(pool, score.tolist()) if s >= asked.sure and x not in asked.skip[1 - k]}
                asked.best[k, label] = dict(sorted(found.items(), key=lambda x: (-x[1], x[0]))[: asked.counts[label]])
        return asked

    known = sorted({r.doc_id: (bytes(r.x), r.y) for r in rows if r.y is not None}.values())
    mixed = np.random.default_rng(5).permutation(len(known))
    t, m = quality.split([x for x, _ in known], 20 + quality.HASHED)
    other = quality.cotrain(t[mixed], m[mixed], np.array([y for _, y in known])[mixed], plain, per_round=0.1)
    x = quality.split(pool, 20 + quality.HASHED)
    assert np.abs(model.probability(*x) - other.probability(*x)).max() < 1e-6 and model.threshold == other.threshold


def test_one_id_in_very_many_rows(spark):
    docs = spark.range(20_000).selectExpr("id % 2 AS doc_id", "concat('some text here ', id % 7) AS text", "'en' AS lang", "'s' AS source", "10L AS n_chars")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    table = quality.prepared(docs, labels)
    assert quality.scores_prepared(table, quality.fit_prepared(table)).count() == 20_000
