"""The event ledger as streams: windows, deduplication, state, and batch views of an ordered log.

Streams read a folder of parquet files with an available-now trigger, so a query
runs to its end; sinks are written under the shared checkpoint folder, never to
a machine-local one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilnwork.runtime import checkpoint_dir
from kilnwork.sources.sinks import exists


def read(spark: SparkSession, path: str, time_col: str = "ts", files: int | None = None) -> DataFrame:
    """A stream over a parquet file or folder with an event-time column of type timestamp, ``files`` at a time."""
    schema = spark.read.parquet(path).schema
    # as a pattern, because a stream takes a plain path for a folder
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    return reader.parquet(f"{path[:-1]}[{path[-1]}]").withColumn(time_col, F.col(time_col).cast("timestamp"))


def run(stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run a stream to its end and read what it wrote.

    Append goes to a parquet sink (exactly once by the sink's log).  The other
    modes write each batch to a folder of its number, so that a batch that is
    replayed writes the same folder again; complete is its last batch, and update
    is the last row of each of ``keys`` over all batches.
    """
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    w = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", base + "/state")
    if mode == "append":
        q = w.format("parquet").option("path", base + "/out").start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(base + "/out")
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys whose last row counts")
    q = w.foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")).start()
    q.awaitTermination()
    written = T.StructType([*stream.schema.fields, T.StructField("epoch", T.LongType())])
    if not exists(spark, base + "/out"):
        return spark.createDataFrame([], stream.schema)
    out = spark.read.schema(written).parquet(base + "/out")
    if mode == "complete":
        return out.join(F.broadcast(out.agg(F.max("epoch").alias("epoch"))), "epoch", "left_semi").drop("epoch")
    rest = [c for c in stream.columns if c not in keys]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("_last")).select(*keys, "_last.*").select(stream.columns)


def tumbling(events: DataFrame, width: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """(start, keys, n, total) per window of event time."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, width: str, slide: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, gap: str, key: str, late: str = "1 hour") -> DataFrame:
    """(key, start, end, n) of sessions: events of a key no further apart than ``gap``."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))
    return w.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def distinct(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def latest_rounds(events: DataFrame, key: str, kind: str, evidence: str) -> DataFrame:
    """(key, last_any, last_evidence): running state per key, updated batch by batch.

    The state is two timestamps a key, however many events it has.
    """
    import pandas as pd

    def step(k: tuple, parts: Iterator, state) -> Iterator:
        any_, ev = state.get if state.exists else (None, None)
        for pdf in parts:
            t = pdf["ts"].max()
            any_ = t.to_pydatetime() if any_ is None or t > pd.Timestamp(any_) else any_
            e = pdf.loc[pdf[kind] == evidence, "ts"]
            if len(e) and (ev is None or e.max() > pd.Timestamp(ev)):
                ev = e.max().to_pydatetime()
        state.update((any_, ev))
        yield pd.DataFrame({key: [k[0]], "last_any": [any_], "last_evidence": [ev]})

    typ = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(
        step, f"{key} {typ}, last_any timestamp, last_evidence timestamp", "last_any timestamp, last_evidence timestamp", "update", "NoTimeout"
    )


def rollup(events: DataFrame) -> DataFrame:
    """(actor, type, n, total, level): counts by type, by actor, by both and overall, in one pass."""
    g = events.groupingSets([["user_id", "event_type"], ["user_id"], ["event_type"], []], "user_id", "event_type")
    return g.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.grouping_id().cast("long").alias("level"))


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key in the order."""
    return events.groupBy(key).agg(F.max(F.struct(*order, *[c for c in events.columns if c not in (*order, key)])).alias("_r")).select(key, "_r.*")


def to_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], where: str):
    """Run ``handle`` on every micro-batch, with its number, so that a replayed batch can be recognised."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", where).trigger(availableNow=True).start()
