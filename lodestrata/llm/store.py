"""Written tables in the cluster's shared folder, used to cut lineage between steps of an operator."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CONF = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where it is missing and all runs in one process."""
    named = spark.sparkContext.getConf().get(_CONF) or spark.conf.get(_CONF, None)
    if named:
        return named
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError(f"{_CONF} must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
    return _own[app]


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lodestrata/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes the application's written tables. Results that still read from them must be stored elsewhere first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back.

    The files are committed by Spark's writer, so a lost executor costs only its unfinished tasks, and
    the reread table has exact size statistics: later joins broadcast it only if it is really small.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes one written table that nothing reads any more."""
    spark, files = table.sparkSession, table.inputFiles()
    if files and files[0].rpartition("/")[0].rpartition("/")[0].endswith(_folder(spark).removeprefix("file://")):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0].rpartition("/")[0])
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of steps whose results are written and whose frames are gone.

    The cleaner waits for the driver to collect its garbage, as `spark.cleaner.periodicGC.interval` makes it do by the clock.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Type of the row identity that `numbered` adds.
ROW = "struct<file:bigint,at:bigint>"


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column that names each physical row: its file (hashed) and its place in it.

    The value is the same in every scan. A number made from partitions is not: how files are split into partitions
    follows the cores at hand, so it changes when executors come or go between two scans. Anything but plain Parquet
    files under projections and filters is written to the shared folder first.
    """
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    if _plain_scan(docs):
        try:
            return docs.withColumn(name, place)
        except AnalysisException:  # not Parquet: no row numbers
            pass
    plain = [f"c{i}" for i in range(len(docs.columns))]
    kept = written(docs.toDF(*plain), "rows").withColumn("row", place)
    return kept.toDF(*docs.columns, name)


def _plain_scan(docs: DataFrame) -> bool:
    """Whether docs is a table of files with nothing but projections and filters above it, each row once."""
    frame = getattr(docs, "_jdf", None)
    if frame is None or "_metadata" in (c.lower() for c in docs.columns):
        return False
    plan = frame.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.getClass().getSimpleName() == "LogicalRelation"
