"""Documents as they arrive: the narrow steps run on streams unchanged; what needs all documents runs on each batch.

Extraction shuffles nothing and keeps no state.  Copies are dropped by digest within the watermark, which bounds the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tracewell.model import CaseConfig
from tracewell.operators import evidence as ev
from tracewell.plans import corpus


def read_texts(spark: SparkSession, path: str, schema: T.StructType | str, max_files: int = 100) -> DataFrame:
    """New Parquet files of a folder, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def distinct_documents(stream: DataFrame, time: str, late: str = "1 hour", text: str = "text") -> DataFrame:
    """The first of equal texts within the watermark."""
    return stream.withColumn("content_sha256", F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).withWatermark(time, late).dropDuplicatesWithinWatermark(["content_sha256"])


def extract_stream(stream: DataFrame, config: CaseConfig = CaseConfig(), key: str = "doc_id", text: str = "text", reference: str | None = None) -> DataFrame:
    """Extracted documents of a stream of texts."""
    return ev.extract_documents(corpus.documents(stream, key, text, reference), config)


def write(extracted: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Mentions of extracted documents to Parquet, exactly once."""
    rows = extracted.select("id", "doc_id", F.explode("found_mentions").alias("m")).select("id", "doc_id", "m.*")
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def claims_per_window(extracted: DataFrame, time: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """How many claims of each predicate arrive in each window; late rows beyond the watermark are dropped by it."""
    rows = extracted.withWatermark(time, late).select(time, F.explode("found_claims").alias("c"))
    return rows.groupBy(F.window(time, window), F.col("c.predicate").alias("predicate")).agg(F.count("*").alias("n"))
