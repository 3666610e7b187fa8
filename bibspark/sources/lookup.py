"""HTTP lookups as a data source: keys of a Parquet table, a request for each, answers as rows.

    spark.dataSource.register(lookup.Lookup)
    spark.read.format("lookup").option("keys", "/table").option("column", "isbn").option("url", "https://host/isbn/{key}.json").load()

Every file of the table is a partition of requests, so the table's layout decides how many run at once. Keys are read where requests
are made; the driver sees names of files only. A request that fails is made again, with a pause; what still fails is a row with its error.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Seconds that a lookup of one book and a search may take (fixed values).
LOOKUP_SECONDS, SEARCH_SECONDS = 10, 15
ANSWER = "key string, status int, body string, error string"


class KeyFile(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def answer(url: str, seconds: float, tries: int, pause: float) -> tuple[int | None, str | None, str | None]:
    """(status, body, error) of a request. Refusals (4xx) are answers; failures of server or network are tried again."""
    error = None
    for k in range(tries):
        if k:
            time.sleep(pause * 2 ** (k - 1))
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "bibspark"}), timeout=seconds) as got:  # noqa: S310
                return got.status, got.read().decode("utf-8", "replace"), None
        except urllib.error.HTTPError as e:
            if e.code < 500:
                return e.code, None, str(e.reason)
            error = f"{e.code} {e.reason}"
        except OSError as e:
            error = str(e)
    return None, None, error


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.keys, self.column, self.url = options["keys"], options["column"], options["url"]
        self.seconds = float(options.get("timeout", SEARCH_SECONDS if options.get("kind") == "search" else LOOKUP_SECONDS))
        self.tries, self.pause = int(options.get("tries", 3)), float(options.get("pause", 0.5))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        address = self.keys if "://" in self.keys else "file://" + self.keys.removeprefix("file:")
        store, place = fs.FileSystem.from_uri(address)
        head = address.removesuffix(place)
        found = store.get_file_info(fs.FileSelector(place, recursive=True))
        return [KeyFile(head + f.path) for f in found if f.is_file and f.path.endswith(".parquet")]

    def read(self, partition: KeyFile) -> Iterator[tuple]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(partition.path)
        with store.open_input_file(place) as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=[self.column]):
                for key in batch.column(0).to_pylist():
                    if key is not None:
                        yield (str(key), *answer(self.url.replace("{key}", urllib.parse.quote(str(key), safe="")), self.seconds, self.tries, self.pause))


class Lookup(DataSource):
    """Options: keys (a Parquet folder), column, url (with {key}); timeout in seconds, or kind = search for the longer one; tries; pause."""

    @classmethod
    def name(cls) -> str:
        return "lookup"

    def schema(self) -> str:
        return ANSWER

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options)


def fetch(keys: DataFrame, column: str, url: str, folder: str, requests_at_once: int = 8, **options: object) -> DataFrame:
    """Answers for each distinct key of a frame: key, status, body, error. The keys are written to ``folder``, in as many files as requests may run at once."""
    spark = keys.sparkSession
    spark.dataSource.register(Lookup)
    keys.select(F.col(column).cast("string").alias(column)).filter(F.col(column).isNotNull()).distinct().repartition(requests_at_once).write.parquet(folder)
    reader = spark.read.format("lookup").options(keys=folder, column=column, url=url)
    return reader.options(**{k: str(v) for k, v in options.items()}).load()
