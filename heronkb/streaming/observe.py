"""Streams: conversation turns become working memory as they arrive, and sessions are watched for size."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import redact, strip, transcript_line
from ..session import shared_folder

TURNS = "conv_id bigint, turn bigint, role string, text string"


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 8) -> DataFrame:
    """A stream of the Parquet files under a path, which may be one file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path) if whole else reader.option("pathGlobFilter", at.getName()).parquet(str(at.getParent()))


def observations(turns: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Working rows, each (agent, session, content) once; repeats are known for the length of the watermark.

    The watermark runs on ``created_at``; a stream without one gets the time of its turn numbers.
    """
    content = redact(transcript_line(F.col("role"), F.col("text")))
    rows = turns.withColumns({"content": content, "agent_id": F.col("role"), "session_id": F.col("conv_id")}).where(strip(F.col("content")) != "")
    if "created_at" not in turns.columns:
        rows = rows.withColumn("created_at", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("turn")))
    hashed = rows.select("agent_id", "session_id", "turn", "content", F.sha2("content", 256).alias("content_hash"), "created_at", F.lit("working").alias("tier"))
    return hashed.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["agent_id", "session_id", "content_hash"])


def session_sizes(rows: DataFrame) -> DataFrame:
    """session_id, n: running number of observations of each session, kept in state and sent when it grows."""

    def grow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(map(len, batches))
        state.update((n,))
        yield pd.DataFrame({"session_id": [key[0]], "n": [n]})

    return rows.groupBy("session_id").applyInPandasWithState(grow, "session_id bigint, n bigint", "n bigint", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote. Offsets, state and output are in the shared folder."""
    spark = stream.sparkSession
    top = f"{shared_folder(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{top}/state").option("path", f"{top}/out").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{top}/out")


def append_to_log(stream: DataFrame, folder: str, state: str):
    """Starts an append of each micro-batch under its own number, so that a batch run twice is written once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", state)
