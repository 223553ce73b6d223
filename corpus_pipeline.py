"""Corpus pipeline: documents through quality filter, line dedup, near-dedup, source mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller writes it as Parquet and reads it again
for the next one. All stages but the last return the columns of `documents`. Stage docstrings say what becomes of
nulls, repeated rows and empty tables; each follows its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import line_dedup, mixing, packing, quality, simhash
from lodestrata.llm.queries import tokenizer
from lodestrata.llm.store import written
from lodestrata.runtime import ship

#: The table's columns, where a stage has to name them.
TEXT, LENGTH = "text", "n_chars"
#: What near-duplicates share: words of a shingle, Jaccard index in percent.
SHINGLE, PERCENT = 5, 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts; texts and rows stay as they are.

    A null text, source, language or length is a value like any other; repeated rows get the same verdict. Without
    labels of both classes nothing is rejected. An empty table stays empty; extra columns stay.
    """
    ship(spark)
    return quality.accepted(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one has; one with nothing left goes. n_chars follows the new text.

    Earlier is a smaller doc_id (null first), then line number. Null and blank texts stay; rows equal in id and text
    are one document and keep the same lines. An empty table stays empty; extra columns stay, whatever their names.
    """
    ship(spark)
    kept = line_dedup.dedup_lines(docs)
    if LENGTH in docs.columns:
        kept = kept.withColumn(LENGTH, F.length(TEXT).cast(docs.schema[LENGTH].dataType))
    return kept.select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of sets of five-word shingles with a Jaccard index of 0.8: that of the smallest id.

    Null, empty and blank texts have the empty set and are one group. Of repeated rows one stays; rows with a null id
    stay only in a group without any id. An empty table stays empty; extra columns stay.
    """
    ship(spark)
    return simhash.dedup(docs, shingle=SHINGLE, percent=PERCENT)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often (0 to 2 times) as the source mix takes them.

    A null source is a source of its own, the last. Documents without words (null texts too) stay once. Repeated rows
    are documents of their own. An empty table stays empty; extra columns stay.
    """
    ship(spark)
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece: its document, place in it, and place in a sequence of 2048 tokens.

    A null text is an empty one: its end id alone. Rows with a null or repeated id are packed like any other. An empty
    table gives none. Other columns aren't needed any more and go.
    """
    ship(spark)
    return packing.best_fit(docs, tokenizer("word_bpe_49k.json"), 0, 2048)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup_stage),
    ("simhash near-dedup", simhash_stage),
    ("source mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: No SQL can express the trained classifier, the tokenizer or the search for bins.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
