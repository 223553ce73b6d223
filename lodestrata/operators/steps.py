"""Steps of an operator that are computed once, in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a counted table up to which it goes to every task.
FEW = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The application's checkpoint folder: that of spark.checkpoint.dir, or a temporary one where all runs in one process."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local($|\[)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestrata-"))
    return context._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and stored in the shared folder, so that later rounds neither repeat it nor grow its plan."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def counted(df: DataFrame) -> DataFrame:
    """df kept, and sent to every task in joins if it was counted to have few rows."""
    stored = kept(df)
    return F.broadcast(stored) if stored.count() <= FEW else stored
