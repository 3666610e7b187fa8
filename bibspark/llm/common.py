"""Helpers shared by the corpus operators: checkpoints, row keys, Arrow batches.

Lineage is cut only by reliable checkpoints in the folder that the cluster names in
``spark.checkpoint.dir``; a lost executor then costs a re-read, not a wrong result.
"""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are maximal runs of anything but ASCII white space (fixed value, used by several contracts).
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; a temporary one only in local mode (tests)."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current:
        return current
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="bibspark-ckpt-")
    context.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of one Arrow batch between Spark and a Python worker. Rows hold whole texts, so that a limit on rows bounds nothing.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_BYTES; they are buffered off the heap on both sides, once per running task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(name)) or 0) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints that nothing refers to any more, instead of holding them until memory runs short."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def row_key(id_col: str, text_col: str) -> Column:
    """Identifies a row by what it holds. Repeated rows (same id, same text) share it, and every operator treats such rows alike."""
    return F.xxhash64(F.col(id_col), F.col(text_col), F.length(text_col))


def column(name: str) -> Column:
    """The column of exactly that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """Names that no column of ``df`` has, in any case of letters."""
    taken = {c.casefold() for c in df.columns}
    out = []
    for stem in stems:
        name = stem
        while name.casefold() in taken:
            name += "_"
        taken.add(name.casefold())
        out.append(name)
    return out


def schema_of(df: DataFrame, names: list[str] | tuple[str, ...], more: str) -> T.StructType:
    """Schema of the named columns of ``df`` followed by ``more`` (DDL of fixed names): column names of a user never go through a parser."""
    return T.StructType([T.StructField(n, df.schema[n].dataType) for n in names] + (T.StructType.fromDDL(more).fields if more else []))


def packed(docs: DataFrame, *plain: str) -> DataFrame:
    """``docs`` as the ``plain`` columns and a struct ``own`` of all the others, so that no temporary name can clash with one of theirs."""
    others = [column(c) for c in docs.columns if c not in plain]
    return docs.select(*plain, (F.struct(*others) if others else F.lit(None).cast("int")).alias("own"))


def unpacked(like: DataFrame, fresh: dict[str, Column]) -> list[Column]:
    """The columns of ``like`` from what packed() made of it: those in ``fresh`` anew, the others out of ``own``."""
    return [(fresh[c] if c in fresh else F.col("own").getField(c)).alias(c) for c in like.columns]


def count_words(text: Column) -> Column:
    """Number of words of a text, 0 for null; JVM only."""
    return F.coalesce(F.size(F.filter(F.split(text, WORD_GAP), lambda w: w != "")), F.lit(0)).cast("long")


def text_slices(texts: pa.Array, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow string array that hold at most ``most_bytes`` of text each (one row at least)."""
    sizes = np.diff(np.asarray(offsets_of(texts)))
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most_bytes:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def offsets_of(texts: pa.Array) -> np.ndarray:
    """Byte offsets (length + 1) of an Arrow string array; nulls are empty."""
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if len(texts) == 0:
        return np.zeros(1, np.int64)
    return np.frombuffer(texts.buffers()[1], kind, count=len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and the offsets of the rows in them; without copying."""
    at = offsets_of(texts)
    held = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def filled(texts: pa.Array) -> pa.Array:
    """The array with nulls as empty strings."""
    return texts.fill_null("") if texts.null_count else texts


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
