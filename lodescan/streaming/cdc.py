"""Change records and new files as streams; every batch runs the same transformations as a batch job."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader, StreamingQuery

from lodescan.operators.cells import document_cells
from lodescan.sources.tables import plain_item, stream_table

CHANGE = "eventName string, eventSourceARN string, dynamodb struct<Keys:string, NewImage:string>"


def _plain(image: str | None) -> str | None:
    return None if image is None else json.dumps(plain_item(json.loads(image)), ensure_ascii=False)


def _decoded(image: Column) -> Column:
    """Plain documents of typed images, a batch at a time."""

    @F.pandas_udf("string")
    def decode(images: pd.Series) -> pd.Series:
        return images.map(_plain)

    return decode(image)


def queued_records(messages: DataFrame, body: str = "body") -> DataFrame:
    """Change or object records out of queue messages: the body is one record, a list under ``Records``, or either of them in a wrapped ``Message``."""
    message = F.coalesce(F.get_json_object(body, "$.Message"), F.col(body))
    records = F.from_json(F.get_json_object(message, "$.Records"), "array<string>")
    return messages.select(F.explode(F.coalesce(records, F.array(message))).alias("record")).where(F.col("record").isNotNull())


def new_objects(messages: DataFrame, body: str = "body") -> DataFrame:
    """bucket, key, size and event of created objects in notifications; removals and empty objects are skipped."""
    rec = queued_records(messages, body)
    get = lambda p: F.get_json_object("record", p)
    rows = rec.select(get("$.s3.bucket.name").alias("bucket"), F.url_decode(get("$.s3.object.key")).alias("key"), get("$.s3.object.size").try_cast("long").alias("size"), get("$.eventName").alias("event"))
    return rows.where(F.col("event").contains("ObjectCreated") & F.col("key").isNotNull() & (F.coalesce("size", F.lit(1)) > 0))


def changed_documents(records: DataFrame) -> DataFrame:
    """New images (unit_id, document) of change records; removals and records without an image are skipped."""
    kept = records.where((F.col("eventName") != "REMOVE") & F.col("dynamodb.NewImage").isNotNull())
    return kept.select(stream_table(F.col("eventSourceARN")).alias("unit_id"), _decoded(F.col("dynamodb.NewImage")).alias("document"))


def changed_cells(records: DataFrame) -> DataFrame:
    return document_cells(changed_documents(records), ["unit_id"], "document")


def change_stream(spark: SparkSession, path: str) -> DataFrame:
    """Change records landing as JSON lines in a folder."""
    reader: DataStreamReader = spark.readStream.schema(CHANGE)
    return reader.option("maxFilesPerTrigger", 100).json(path)


def object_stream(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """New files of a folder as they land: path, modificationTime, length, content."""
    reader = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1000)
    schema = "path string, modificationTime timestamp, length long, content binary"
    return (reader.option("pathGlobFilter", glob) if glob else reader).schema(schema).load(path)


def run_stream(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Hand every micro-batch to ``handle``; progress is kept in the checkpoint folder, so nothing is scanned twice."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()
