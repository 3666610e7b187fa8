"""Streaming forms with keyed state: import of new files, and the life cycle of deleted ones by event time.

State is per file or per entry and lives in the state store, so that neither the catalogue nor the bin is read again in each batch. Sinks are
the engine's own: a batch that is replayed adds nothing twice.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources import files

BINARY = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
#: The state store that keyed state needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(spark: SparkSession) -> None:
    """Keyed state of any kind needs this store; streams that begin from now on use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


# ---------------------------------------------------------------- import
def _begun(spark: SparkSession, checkpoint: str) -> bool:
    """Whether a stream has finished a batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(path) and any(x.getPath().getName().isdigit() for x in fs.listStatus(path))


def first_seen(rows: DataFrame, key: str, checkpoint: str, known: DataFrame | None = None) -> DataFrame:
    """Of a stream one row of each ``key``, unless ``known`` (any columns with the key) has it. Null keys are one key.

    Keys of ``known`` are written beside the stream's logs once and enter the keyed state as rows of the first batch. As no order holds inside
    a batch, rows are also held against them until that batch is done; later starts know them from state alone.
    """
    spark = rows.sparkSession
    with_state(spark)
    folder = f"{checkpoint}/known"
    kind = T.StructType([T.StructField(key, rows.schema[key].dataType)])
    if not files._exists(spark, f"{folder}/_SUCCESS"):
        own = spark.createDataFrame([], kind) if known is None else known.select(F.col(key).cast(kind[0].dataType)).distinct()
        own.write.mode("overwrite").parquet(folder)
    if not _begun(spark, checkpoint):
        there = spark.read.schema(kind).parquet(folder).withColumnRenamed(key, "__there")
        rows = rows.join(there, F.col(key).eqNullSafe(F.col("__there")), "left_anti")
    seeds = spark.readStream.schema(kind).parquet(folder).select(*(F.col(key) if f.name == key else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema), F.lit(True).alias("__known"))
    return rows.withColumn("__known", F.lit(False)).unionByName(seeds).dropDuplicates([key]).filter("not __known").drop("__known")


def import_stream(spark: SparkSession, folder: str, catalogue_path: str, checkpoint: str, known: DataFrame | None = None) -> StreamingQuery:
    """Parse files as they appear in ``folder`` and append those not met before, in this stream or in ``known`` (a catalogue, read once, when the
    stream first starts). The table at ``catalogue_path`` is this stream's own: its log makes a replayed batch add nothing twice."""
    found = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True).load(folder).filter(files.supported(F.col("path")))
    return append_new(files.parse(found), catalogue_path, checkpoint, known)


def append_new(books: DataFrame, catalogue_path: str, checkpoint: str, known: DataFrame | None = None) -> StreamingQuery:
    """Append a stream's books by ``file_path`` to a table of its own, each once, without those of ``known``."""
    new = first_seen(books, "file_path", checkpoint, known)
    return new.writeStream.format("parquet").option("path", catalogue_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ---------------------------------------------------------------- life cycle of the bin
#: What can happen to a file, and what becomes of a deletion: given back, destroyed, deleted again before either, or past its time.
DELETE, RESTORE, PURGE = "delete", "restore", "purge"
OUTCOMES = {RESTORE: "restored", PURGE: "purged", DELETE: "replaced"}
#: Times as microseconds, as state and workers hold them.
ENDED = T.StructType([T.StructField("id", T.StringType()), T.StructField("deleted", T.LongType()), T.StructField("outcome", T.StringType()), T.StructField("ended", T.LongType())])


class _Bin(StatefulProcessor):
    """One file: events wait until the watermark has passed them, then take effect in order; a deletion still open sets the timer at which it expires."""

    def __init__(self, days: float):
        self.ttl = int(days * 86_400_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        long = lambda name: T.StructField(name, T.LongType())
        self.waiting = handle.getListState("waiting", T.StructType([long("us"), long("seq"), T.StructField("kind", T.StringType())]))
        self.bin = handle.getValueState("deleted", T.StructType([long("us")]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = [(int(us), int(seq), kind) for batch in rows for us, seq, kind in zip(batch["us"], batch["seq"], batch["kind"], strict=True)]
        if fresh:
            self.waiting.appendList(fresh)
            self.handle.registerTimer(min(fresh)[0] // 1000 + 1)  # one for all: when it fires, what is due is settled, and the next one set
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000  # a timer set in the past would wait for the next batch
        held = sorted(tuple(x) for x in self.waiting.get())
        due, later = [x for x in held if x[0] < now], [x for x in held if x[0] >= now]
        if due and later:
            self.waiting.put(later)
        elif due:
            self.waiting.clear()
        if later:
            self.handle.registerTimer(later[0][0] // 1000 + 1)
        out = []
        since = self.bin.get()[0] if self.bin.exists() else None
        ttl = self.ttl * 1000
        for us, _, kind in due:
            if since is not None and us > since + ttl:
                out.append((since, "expired", since + ttl))
                since = None
            if since is not None:
                out.append((since, OUTCOMES[kind], us))
                since = None
            if kind == DELETE:
                since = us
        if since is not None and now > since + ttl:
            out.append((since, "expired", since + ttl))
            since = None
        if since is None:
            self.bin.clear()
        else:
            self.bin.update((since,))
            self.handle.registerTimer((since + ttl) // 1000 + 1)
        if out:
            yield pd.DataFrame({"id": [key[0]] * len(out), "deleted": [x[0] for x in out], "outcome": [x[1] for x in out], "ended": [x[2] for x in out]})

    def close(self) -> None:
        pass


def bin_outcomes_stream(events: DataFrame, days: float, late: str = "0 seconds") -> DataFrame:
    """(id, deleted, outcome, ended) of every deletion that has come to an end by the watermark.

    ``events`` is a stream of (id, seq, kind, ts): kind is delete, restore or purge; ``seq`` orders what happens at one time. A deletion ends with
    the file's next event within ``days``, else it expires. Rows up to ``late`` behind are put in their place; what is later still is dropped,
    as watermarks do. Equal to bin_outcomes() of the same events at the watermark's time.
    """
    with_state(events.sparkSession)
    own = events.withWatermark("ts", late).select(F.col("id").cast("string").alias("id"), F.col("seq").cast("long").alias("seq"), "kind", F.unix_micros("ts").alias("us"), "ts")
    found = own.groupBy("id").transformWithStateInPandas(statefulProcessor=_Bin(days), outputStructType=ENDED, outputMode="Append", timeMode="EventTime")
    return found.select("id", F.timestamp_micros("deleted").alias("deleted"), "outcome", F.timestamp_micros("ended").alias("ended"))


def bin_outcomes(events: DataFrame, days: float, now: dt.datetime | None = None) -> DataFrame:
    """The same of a table of events, at ``now`` (the last event's time where none is given)."""
    order = Window.partitionBy("id").orderBy("ts", "seq")
    own = events.withColumns({"id": F.col("id").cast("string"), "next": F.lead("ts").over(order), "then": F.lead("kind").over(order)}).filter(F.col("kind") == DELETE)
    limit = F.col("ts") + F.make_dt_interval(secs=F.lit(days * 86_400))
    at = F.lit(now) if now is not None else F.lit(events.agg(F.max("ts")).first()[0])
    known = F.create_map(*(F.lit(x) for pair in OUTCOMES.items() for x in pair))
    met = F.col("next").isNotNull() & (F.col("next") <= limit)
    outcome = F.when(met, F.try_element_at(known, F.col("then"))).when(limit < at, F.lit("expired"))
    return own.select("id", F.col("ts").alias("deleted"), outcome.alias("outcome"), F.when(met, F.col("next")).otherwise(limit).alias("ended")).filter("outcome is not null")


def deletions_per_window(deletions: DataFrame, time_col: str = "ts", late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """Deleted bytes and files per window of event time, late rows admitted up to a watermark. Batch or stream."""
    own = deletions.withWatermark(time_col, late) if deletions.isStreaming else deletions
    return own.groupBy(F.window(time_col, width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("bytes")).select("w.start", "w.end", "n", "bytes")
