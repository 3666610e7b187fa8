"""Web archives, index first: where every record will stand is known before a byte of it is written, and a read touches only what it needs.

The index has a row per record: archive, offset, length, address, digest. It comes from sizes and digests alone. The archives follow from
the same rows in the same order, written by Spark's own text sink (a WARC record ends with an empty line, which is the sink's line
separator), so a task that is repeated leaves no half archive. A read takes any rows of the index, joins neighbouring byte ranges of one
archive and fetches each range once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, checkpointed, column, ensure_checkpoint_dir, release

#: Payloads under this many bytes are always written in full.
LEAST_SHARED = 100
#: Aimed bytes of an archive and of one read; ranges with a gap of at most GAP_BYTES between them are read as one. Most bytes that a task is to read.
ARCHIVE_BYTES, READ_BYTES, GAP_BYTES, TASK_BYTES = 32 << 20, 4 << 20, 64 << 10, 128 << 20
#: Passes in which archives are written: only such a part of all payloads is in shuffle files at a time.
WAVES = 5
#: Rows of shared payloads that may be broadcast (about 100 bytes each); beyond, they are joined by a shuffle.
BROADCAST_SHARED = 1 << 18
#: Fixed values of the format.
END, DATE = "\r\n\r\n", "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:x-page:"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _described(pages: DataFrame, least: int, broadcast_shared: int) -> DataFrame:
    """``pages`` (page_id, url, html) with bytes, digest, type and refers_to of their records."""
    own = pages.withColumn("html", F.coalesce("html", F.lit("")))
    own = own.withColumns({"bytes": F.octet_length("html").cast("long"), "digest": F.sha2(F.encode("html", "UTF-8"), 256)})
    # the bytes of equal payloads are equal, so that the smallest page of a digest is all that is needed; one row a page left of a task
    shared = own.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = checkpointed(shared.filter("n > 1 and first is not null").select("digest", "first"))
    if shared.count() <= broadcast_shared:
        shared = F.broadcast(shared)
    met = own.join(shared, "digest", "left")
    return met.withColumn("refers_to", F.when((F.col("bytes") >= least) & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))).drop("first")


def _head(record: DataFrame) -> DataFrame:
    """Adds ``head``: the record up to its payload. A revisit has the head of its response's HTTP message, no payload."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), line("Content-Type", F.lit("text/html; charset=UTF-8")), line("Content-Length", F.col("bytes").cast("string")), F.lit("\r\n"))
    address = F.replace(F.replace(_text("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    named = lambda id_col: F.concat(F.lit(f"<{NAME}"), _text(id_col), F.lit(">"))
    body = F.octet_length("http") + F.when(revisit, 0).otherwise(F.col("bytes"))
    warc = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", named("page_id")),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", address),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", named("refers_to")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", body.cast("string")),
        F.lit("\r\n"),
    )
    return record.withColumn("http", http).withColumn("head", F.concat(warc, "http")).drop("http")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_SHARED, archive_bytes: int = ARCHIVE_BYTES, broadcast_shared: int = BROADCAST_SHARED) -> DataFrame:
    """Write ``folder``/index (Parquet), then ``folder``/archives (one WARC file each), and return the index.

    A row of ``pages`` is a record: its payload the html in UTF-8, null as empty. Of equal payloads of ``least`` bytes or more the one with the
    smallest id is a response, the others are revisits of it; smaller ones, and those none of which has an id, are all responses.
    Index: page_id, url, digest (SHA-256 of the payload), bytes (of the payload), record_type, refers_to, archive, offset, length.
    Repeated rows are a record each and alike; null addresses are written as empty; an empty table gives an empty index and no archive;
    other columns are ignored. Archives get about ``archive_bytes``; a longer payload stays whole. Ids must be of an orderable type.
    """
    spark = pages.sparkSession
    own = pages.select(column(id_col).alias("page_id"), column(url_col).cast("string").alias("url"), column(html_col).cast("string").alias("html"))
    records = _head(_described(own, least, broadcast_shared)).withColumn("length", F.octet_length("head") + F.when(F.col("refers_to").isNull(), F.col("bytes")).otherwise(0) + len(END))
    sized = checkpointed(records.drop("html", "head"))
    n = max(1, -(-(sized.agg(F.sum("length")).first()[0] or 0) // archive_bytes))
    archive = F.pmod(F.xxhash64(_text("page_id")), F.lit(n)).cast("int")
    order = ["page_id", "url", "digest"]  # rows equal in these are equal
    before = F.sum("length").over(Window.partitionBy("archive").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    placed = sized.withColumn("archive", archive).withColumn("offset", F.coalesce(before, F.lit(0)).cast("long"))
    kind = F.when(F.col("refers_to").isNull(), F.lit("response")).otherwise(F.lit("revisit"))
    placed.select("page_id", "url", "digest", "bytes", kind.alias("record_type"), "refers_to", "archive", "offset", F.col("length").cast("long").alias("length")).write.parquet(f"{folder}/index")
    said = F.concat("head", F.when(F.col("refers_to").isNull(), F.col("html")).otherwise(F.lit("")))
    for wave in range(WAVES):
        own_wave = records.withColumn("archive", archive).filter(F.col("archive") % WAVES == wave).select("archive", *order, said.alias("value"))
        dealt = own_wave.repartition(-(-n // WAVES), "archive").sortWithinPartitions("archive", *order)
        dealt.select("archive", "value").write.mode("append").partitionBy("archive").option("lineSep", END).text(f"{folder}/archives")
        release(spark)
    return spark.read.parquet(f"{folder}/index")


def archive_files(spark: SparkSession, folder: str) -> DataFrame:
    """(archive, path, size) of the archives of a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/archives")
    return files.select(F.regexp_extract("path", "/archive=([0-9]+)/", 1).cast("int").alias("archive"), "path", F.col("length").alias("size")).filter("size > 0")


def ranges(index: DataFrame, read_bytes: int = READ_BYTES, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """(archive, start, stop, records): the byte ranges to read for the rows of ``index``, each with its records (offset, length, by offset).

    Ranges at most ``gap_bytes`` apart are one; a range begins within one stretch of ``read_bytes`` of its archive, so that it is bounded by
    that and one record.
    """
    block = ["archive", "block"]
    inside = Window.partitionBy(*block).orderBy("offset")
    own = index.select("archive", "offset", "length").distinct().withColumn("block", F.floor(F.col("offset") / read_bytes))
    last = F.lag(F.col("offset") + F.col("length")).over(inside)
    own = own.withColumn("new", F.when(F.col("offset") - last <= gap_bytes, 0).otherwise(1)).withColumn("k", F.sum("new").over(inside))
    met = own.groupBy(*block, "k").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"), F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("records"))
    return met.select("archive", "start", "stop", "records")


RECORD = "archive int, offset long, record_type string, record_id string, url string, digest string, refers_to string, bytes long, payload binary"


def _fields(block: bytes) -> dict[str, str]:
    """Header lines after the first one, names in lower case."""
    lines = block.decode("utf-8").split("\r\n")[1:]
    return {name.lower(): value for name, _, value in (x.partition(": ") for x in lines)}


def _parsed(said: bytes) -> dict:
    """A record as its fields; raises where it is not one."""
    head, _, rest = said.partition(END.encode())
    if not head.startswith(b"WARC/1.") or not said.endswith(END.encode()):
        raise ValueError("not a WARC record")
    warc = _fields(head)
    body = rest[: int(warc["content-length"])]
    http, _, payload = body.partition(END.encode())
    revisit = warc["warc-type"] == "revisit"
    return {
        "record_type": warc["warc-type"],
        "record_id": warc["warc-record-id"][1:-1],
        "url": warc["warc-target-uri"],
        "digest": warc["warc-payload-digest"].removeprefix("sha256:"),
        "refers_to": warc["warc-refers-to"][1:-1] if revisit else None,
        "bytes": int(_fields(http)["content-length"]),
        "payload": None if revisit else payload,
    }


def read_records(index: DataFrame, folder: str, read_bytes: int = READ_BYTES, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """The records at the places that ``index`` (any rows of it) names: archive, offset, record_type, record_id, url, digest, refers_to, bytes,
    payload (null for revisits). Each place comes once. ``folder`` must be in a store that pyarrow opens by its address (local, HDFS, S3, GCS)."""
    spark = index.sparkSession
    bounded_batches(spark)
    wanted = ranges(index, read_bytes, gap_bytes).join(archive_files(spark, folder), "archive").select("archive", "path", "start", "stop", "records")
    names = [f.name for f in T.StructType.fromDDL(RECORD)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        kinds = pa.schema([("archive", pa.int32()), ("offset", pa.int64()), *((n, pa.string()) for n in names[2:7]), ("bytes", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                path = row["path"] if "://" in row["path"] else "file://" + row["path"].removeprefix("file:")
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_file(place) as f:
                    said = f.read_at(row["stop"] - row["start"], row["start"])
                found = []
                for r in row["records"]:
                    at = r["offset"] - row["start"]
                    found.append({"archive": row["archive"], "offset": r["offset"], **_parsed(said[at : at + r["length"]])})
                yield pa.RecordBatch.from_pylist(found, schema=kinds)

    # a range is a small row and much to read: the number of tasks follows the bytes, not the rows
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    return wanted.repartition(tasks, "archive", "start").mapInArrow(run, RECORD)


def fresh_folder(spark: SparkSession) -> str:
    """A new folder for archives in the place that the cluster shares."""
    return f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Write all ``pages`` as archives into ``folder`` and read every record back. Per record: page_id, payload_bytes, payload_digest,
    record_type, refers_to, url. What is read decides: a response's size and digest are those of the bytes that came back, a revisit's those
    that its record states. The ids are those of the index rows at the records' places."""
    index = write_archives(pages, folder)
    back = read_records(index, folder)
    full = F.col("payload").isNotNull()
    kind = index.schema["page_id"].dataType
    page = lambda name: F.nullif(F.regexp_replace(name, f"^{NAME}", ""), F.lit("")).cast(kind)
    return back.select(
        page("record_id").alias("page_id"),
        F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(full, F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
        "url",
    )
