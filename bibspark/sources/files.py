"""Book files as a table: scan directories, parse by extension, import into a catalogue; JSON in and out."""

from __future__ import annotations

import re
import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import text
from ..schema import BOOK, ENTRY, FINGERPRINT
from . import epub

PARSED = T.StructType([*(T.StructField(c, T.StringType()) for c in ("title", "author", "publisher", "publish_date", "isbn", "language", "description")), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("cover_path", T.StringType()), T.StructField("lead_text", T.StringType())])


def scan(spark: SparkSession, folders: list[str], recursive: bool = True, suffixes: list[str] = K.EXTENSIONS) -> DataFrame:
    """(path, modificationTime, length, content) of book files; roots that overlap give their files more than once, and a missing root gives none."""
    out = spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    for folder in filter(lambda f: _exists(spark, f), folders):
        own = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("ignoreMissingFiles", True).load(folder)
        out = out.unionByName(own)
    return out.filter(supported(F.col("path"), suffixes))


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def supported(path: Column, suffixes: list[str] = K.EXTENSIONS) -> Column:
    return text.suffix(path).isin(suffixes)


def file_format(path: Column) -> Column:
    return F.ltrim(text.suffix(path), F.lit("."))


def mobi_metadata(content: bytes) -> dict[str, str]:
    """Title from the 32-byte name of the database header."""
    return {"title": content[:32].split(b"\0")[0].decode("utf-8", "ignore").strip()}


def mobi_text(content: bytes, most: int = 1000) -> str:
    """Text of the first records: code page from the header, all but word characters blanked."""
    try:
        (start,) = struct.unpack(">I", content[78:82])
        codec = "utf-8" if struct.unpack(">I", content[start + 28 : start + 32])[0] == 65001 else "cp1252"
    except struct.error:
        return ""
    return re.sub(r"\s+", " ", re.sub(r"[^\w]", " ", content[start + 232 :].decode(codec, "ignore"))).strip()[:most]


def _pdf(content: bytes) -> dict[str, str]:
    """Information dictionary and leading text, where the optional library is present."""
    try:
        import io

        from PyPDF2 import PdfReader
    except ImportError:
        return {}
    try:
        reader = PdfReader(io.BytesIO(content))
        info, pages, held = reader.metadata or {}, [], 0
        for page in reader.pages:
            try:
                pages.append(page.extract_text() or "")
            except Exception:  # noqa: BLE001, S112  a broken page is skipped
                continue
            held += len(pages[-1])
            if held >= 1000:
                break
        get = lambda name, other: str(info.get(name, info.get(other, "")) or "")
        fields = {"title": get("/Title", ""), "author": get("/Author", ""), "publisher": get("/Publisher", "/Producer"), "publish_date": get("/CreationDate", ""), "description": get("/Subject", "/Keywords")}
        return {k: clean_pdf_text(v) for k, v in fields.items()} | {"lead_text": " ".join(pages)[:1000]}
    except Exception:  # noqa: BLE001  any unreadable file has no metadata
        return {}


def clean_pdf_text(value: str) -> str:
    value = re.sub(r"^[Dd]:", "", value.removeprefix("/"))
    try:
        value = value.encode("latin-1").decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        pass
    return value.strip()


def parse_one(kind: str, content: bytes | None) -> dict[str, object]:
    content = content or b""
    if kind == "epub":
        return epub.read_metadata(content) | {"lead_text": epub.read_text(content)}
    if kind == "mobi":
        return mobi_metadata(content) | {"lead_text": mobi_text(content)}
    return _pdf(content) if kind == "pdf" else {}


#: Files come to Python some at a time, as rows: an Arrow batch would hold 10,000 files and their fields at once, whatever their size.
@F.udf(PARSED, useArrow=False)
def parse_content(kind: str | None, content: bytes | None) -> tuple:
    found = {"tags": [], "cover_path": None} | parse_one(kind, None if content is None else bytes(content))
    return tuple(found.get(c, "") for c in PARSED.names)


def parse(files: DataFrame) -> DataFrame:
    """A catalogue of scanned files: path, format, size, metadata; a missing title is the file's stem."""
    kind = file_format(F.col("path"))
    own = files.select("path", F.col("length").alias("file_size"), kind.alias("file_format"), parse_content(kind, F.col("content")).alias("m"))
    title = F.coalesce(F.nullif(F.col("m.title"), F.lit("")), text.stem(F.col("path")))
    return own.select(title.alias("title"), *(F.col(f"m.{c}") for c in PARSED.names if c != "title"), F.col("path").alias("file_path"), "file_format", "file_size")


def import_new(catalogue: DataFrame, fresh: DataFrame) -> DataFrame:
    """The catalogue plus the files it does not have yet, one row per path."""
    new = fresh.dropDuplicates(["file_path"]).join(catalogue.select("file_path"), "file_path", "left_anti")
    return catalogue.unionByName(new, allowMissingColumns=True)


# ---------------------------------------------------------------- JSON
def _defaults(kind: T.DataType) -> Column | None:
    by = {"string": F.lit(""), "bigint": F.lit(0).cast("long"), "double": F.lit(0.0), "boolean": F.lit(False), "array<string>": F.array().cast("array<string>")}
    return by.get(kind.simpleString())


def _filled(value: Column, schema: T.StructType, nullable: tuple[str, ...] = ("cover_path",)) -> list[Column]:
    """Fields of a struct with defaults for what is missing."""
    out = []
    for field in schema.fields:
        own = value[field.name]
        if isinstance(field.dataType, T.StructType):
            own = F.struct(*_filled(own, field.dataType))
        elif field.name not in nullable and (default := _defaults(field.dataType)) is not None:
            own = F.coalesce(own, default)
        out.append(own.alias(field.name))
    return out


def books_from_json(rows: DataFrame, json_col: str = "value") -> DataFrame:
    """Books from JSON objects; unknown keys are ignored, missing ones get defaults, unreadable text gives a row of defaults."""
    return rows.select(*_filled(F.from_json(json_col, BOOK), BOOK))


def fingerprints_from_json(rows: DataFrame, json_col: str = "value") -> DataFrame:
    return rows.select(*_filled(F.from_json(json_col, FINGERPRINT), FINGERPRINT))


def index_from_json(rows: DataFrame, json_col: str = "value") -> DataFrame:
    """Bin entries from an index file, a JSON object by id; an unreadable one is empty."""
    whole = F.from_json(json_col, T.MapType(T.StringType(), ENTRY))
    entries = rows.select(F.explode(F.coalesce(whole, F.create_map().cast(T.MapType(T.StringType(), ENTRY)))).alias("key", "e"))
    fields = _filled(F.col("e"), ENTRY)
    return entries.select(F.coalesce("e.id", "key").alias("id"), *(f for f, s in zip(fields, ENTRY.fields, strict=True) if s.name != "id"))


def to_json(rows: DataFrame) -> DataFrame:
    """One JSON object per row, nulls included."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_index(entries: DataFrame, path: str) -> None:
    """The whole index anew."""
    entries.write.mode("overwrite").parquet(path)


def save_epub_rows(rows: DataFrame, content: str = "content", changes: str = "changes") -> DataFrame:
    """``rows`` with ``saved``: the EPUB bytes of ``content`` with the metadata map ``changes`` written, null if it is no readable EPUB."""

    @F.udf(T.BinaryType(), useArrow=False)  # rows, as in parse_content()
    def save(raw: bytes | None, new: dict[str, str] | None) -> bytes | None:
        return None if raw is None else epub.write_metadata(bytes(raw), new or {})

    return rows.withColumn("saved", save(F.col(content), F.col(changes)))
