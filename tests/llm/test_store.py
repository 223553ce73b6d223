import itertools

import pytest

from lodestrata.llm import line_dedup, mixing, simhash, store

TEXTS = [f"w{i} common words of a line that many share here\nand a line of its own {i} {i * i} {i + 7} and {i % 3}" for i in range(60)]


@pytest.fixture
def docs(spark, tmp_path):
    rows = [(i, TEXTS[i % 40], "en", f"s{i % 3}", len(TEXTS[i % 40])) for i in range(400)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    made.repartition(7).write.parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


@pytest.fixture
def moving_splits(spark, monkeypatch):
    """Files are split anew after each written table, as when executors come and go."""
    conf = "spark.sql.files.maxPartitionBytes"
    was, real, sizes = spark.conf.get(conf), store.written, itertools.cycle(["1500", "90000000", "4000"])

    def written(*args, **kwargs):
        out = real(*args, **kwargs)
        spark.conf.set(conf, next(sizes))
        return out

    for module in (line_dedup, mixing, simhash):
        monkeypatch.setattr(module, "written", written)
    yield
    spark.conf.set(conf, was)


STEPS = {"lines": line_dedup.dedup_lines, "simhash": simhash.dedup, "mixing": mixing.mixed_documents}


@pytest.mark.parametrize("step", STEPS)
def test_rows_keep_their_identity_when_splits_change(spark, docs, request, step):
    want = sorted(STEPS[step](docs).collect())
    request.getfixturevalue("moving_splits")
    assert sorted(STEPS[step](docs).collect()) == want


def test_numbers_are_unique_with_and_without_files(spark, docs):
    from pyspark.sql import functions as F

    exploded = docs.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("_metadata"))
    for frame, n in ((docs, 400), (docs.where("doc_id < 50").select("text"), 50), (exploded, 800), (docs.union(docs), 800), (docs.join(docs.select("doc_id"), "doc_id"), 400), (spark.range(30), 30), (docs.select("doc_id", F.col("text").alias("DOC_ID")), 400)):
        found = store.numbered(frame, "__row")
        assert found.columns == [*frame.columns, "__row"]
        assert found.select("__row").distinct().count() == found.count() == n


def test_clear_removes_the_tables_of_the_application(spark):
    table = store.written(spark.range(5), "gone")
    assert table.count() == 5 and table.inputFiles()
    store.clear(spark)
    import os
    from urllib.parse import urlparse

    assert not any(os.path.exists(urlparse(f).path) for f in table.inputFiles())


def test_a_cluster_without_a_shared_folder_is_refused(spark):
    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError):
        store.shared_dir(Session())
