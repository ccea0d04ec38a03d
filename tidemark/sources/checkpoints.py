"""Where steps leave what the next ones read: the folder that the whole cluster shares."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and tables between steps: ``spark.checkpoint.dir``, which all machines share.

    Where the session has none, a folder of our own is made, but only if Spark
    runs on this one machine; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
            folder = tempfile.mkdtemp(prefix="tidemark-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


#: With this, Spark removes a query's shuffle files when the query is over. Else they stay as long as the checkpointed DataFrame.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Where one side of a join turns out to be empty, this rule ends the query while tasks of the other side run on. Their shuffles
#: would be gone with the query, and on a cluster each such task holds its core until its question for them times out.
EARLY_END = "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"
EXCLUDED = "spark.sql.adaptive.optimizer.excludedRules"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; the shuffles behind it are freed."""
    spark = df.sparkSession
    shared_folder(spark)
    before, excluded = spark.conf.get(CLEANUP), spark.conf.get(EXCLUDED, None)
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(EXCLUDED, f"{excluded},{EARLY_END}" if excluded else EARLY_END)
    try:
        kept = df.select("*").checkpoint(eager=True)  # a query takes the settings it was made under
    finally:
        spark.conf.set(CLEANUP, before)
        spark.conf.unset(EXCLUDED) if excluded is None else spark.conf.set(EXCLUDED, excluded)
    del df
    # Checkpoints that nothing refers to any more go when both sides have let go of them.
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return kept
