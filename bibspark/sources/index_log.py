"""The bin's index as an append-only log of JSON events, compacted now and then into the JSON index form that files.index_from_json reads.

A folder holds versions ``v=1``, ``v=2``, ...; each is a ``base`` (JSON objects of entries by id) and a ``log`` of later events. Writers append to the
newest complete version, whose base is whole once its marker stands, so that a compaction that dies changes nothing. Of an id the
event with the largest ``seq`` counts; an event that is written twice counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import ENTRY
from . import files

PUT, DROP = "put", "drop"
EVENT = T.StructType([T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), *ENTRY.fields])
#: Entries of one JSON object of a base.
OBJECT_ENTRIES = 4096


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder of any store that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    store, at = _folder(spark, path)
    return store.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    store, at = _folder(spark, path)
    store.delete(at, True)


def version(spark: SparkSession, path: str) -> int:
    """The newest complete version; 0 where there is none yet."""
    store, at = _folder(spark, path)
    names = [s.getPath().getName() for s in store.listStatus(at)] if store.exists(at) else []
    whole = [int(n[2:]) for n in names if n.startswith("v=") and _exists(spark, f"{path}/{n}/base/_SUCCESS")]
    return max(whole, default=0)


def append(events: DataFrame, path: str) -> None:
    """Add events: rows of an entry's columns with ``seq`` and ``op`` (put or drop; of a drop only the id counts)."""
    given = {f.name for f in events.schema.fields}
    rows = events.select(*(F.col(f.name) if f.name in given else F.lit(None).cast(f.dataType).alias(f.name) for f in EVENT.fields))
    rows.write.mode("append").json(f"{path}/v={version(events.sparkSession, path)}/log")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The entries that stand now; none where nothing was written."""
    at = f"{path}/v={version(spark, path)}"
    rows = spark.createDataFrame([], EVENT)
    if _exists(spark, f"{at}/log"):
        rows = spark.read.schema(EVENT).json(f"{at}/log")
    if _exists(spark, f"{at}/base"):
        base = files.index_from_json(spark.read.text(f"{at}/base"))
        rows = rows.unionByName(base.select(F.lit(None).cast("long").alias("seq"), F.lit(PUT).alias("op"), *ENTRY.names))
    last = rows.groupBy("id").agg(F.max_by(F.struct("op", *(n for n in ENTRY.names if n != "id")), F.coalesce("seq", F.lit(-(1 << 63)))).alias("e"))
    return last.filter(F.col("e.op") == PUT).select("id", *(F.col(f"e.{n}").alias(n) for n in ENTRY.names if n != "id"))


def compact(spark: SparkSession, path: str) -> None:
    """Write what stands now as the next version's base, then remove the versions before it. Events appended meanwhile would be lost: one writer at a time."""
    now, own = version(spark, path), load(spark, path)
    objects = max(1, -(-own.count() // OBJECT_ENTRIES))
    shard = F.pmod(F.xxhash64("id"), F.lit(objects))
    entry = F.struct(*(n for n in ENTRY.names if n != "id"))
    whole = own.groupBy(shard.alias("shard")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("id", entry)))).alias("value"))
    whole.select("value").write.text(f"{path}/v={now + 1}/base")
    remove(spark, f"{path}/v={now}")
