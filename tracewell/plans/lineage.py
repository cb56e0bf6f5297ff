"""Where plans are cut: results that several later steps read are computed once and kept in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share; a temporary one only where none is set and the master is local."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tracewell-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: it outlives executors, and later plans start from it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


#: A task's share of narrow rows that cost far more CPU than bytes: some 15,000 orders.
SPREAD_BYTES = 256 * 1024
#: More tasks than this only cost scheduling; their shares grow instead.
MOST_PARTS = 4096


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows dealt to tasks by their number, not by their files': what is made of a row costs far more than reading it.

    A small file is one task however many cores there are; the size comes from the plan's statistics, no job is run.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // SPREAD_BYTES))
    return df.repartition(min(parts, MOST_PARTS), *keys)


class Written:
    """A result written as a table in the shared folder.

    Unlike a checkpoint it is known by its size: plans that join what earlier rounds joined stay small, and it can be dropped.
    """

    def __init__(self, df: DataFrame):
        self.spark, self.path = df.sparkSession, new_folder(df.sparkSession, "written")
        # Mostly hashes, which neither compress nor repeat: codecs' buffers would be many tasks' memory for nothing.
        df.write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Removes the files; nothing that is still to be computed may need them."""
        remove(self.spark, self.path)


def written(df: DataFrame) -> DataFrame:
    return Written(df).df


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
