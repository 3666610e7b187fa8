"""Format-conversion jobs: planning and bookkeeping. Running the converter is left to a caller's function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import stem, suffix


def conversions(spark: SparkSession) -> DataFrame:
    """(source_format, target_format), a fixed table."""
    return spark.createDataFrame([(s, t) for s, ts in K.CONVERSIONS.items() for t in ts], "source_format string, target_format string")


def targets(books: DataFrame) -> DataFrame:
    """Formats that some selected book can be turned into, in order."""
    return books.join(F.broadcast(conversions(books.sparkSession)), F.lower("file_format") == F.col("source_format")).select("target_format").distinct().orderBy("target_format")


def output_path(input_path: Column, target: Column, folder: str = "") -> Column:
    own = F.regexp_extract(input_path, "^(.*/)?[^/]*$", 1)
    return F.concat(F.lit(f"{folder.rstrip('/')}/") if folder else own, stem(input_path), F.lit("."), F.lower(target))


def planned(tasks: DataFrame, tool_present: bool = True) -> DataFrame:
    """``tasks`` (input_path, output_format, input_exists) with output_path, status and error; what may run is ``pending``."""
    supported = F.coalesce(F.array_contains(F.try_element_at(F.create_map(*(x for s, ts in K.CONVERSIONS.items() for x in (F.lit(s), F.array(*map(F.lit, ts))))), F.ltrim(suffix(F.col("input_path")), F.lit("."))), F.lower("output_format")), F.lit(False))
    error = F.when(F.lit(not tool_present), "converter not found").when(~F.col("input_exists"), "input not found").when(~supported, "conversion not supported").otherwise("")
    own = tasks.withColumn("output_path", output_path(F.col("input_path"), F.col("output_format"))).withColumn("error", error)
    return own.withColumn("status", F.when(F.col("error") == "", "pending").otherwise("error"))


def summary(tasks: DataFrame) -> DataFrame:
    return tasks.agg(F.count_if(F.col("status") != "error").alias("n_ok"), F.count_if(F.col("status") == "error").alias("n_failed"))


def run(tasks: DataFrame, command: str = "ebook-convert", timeout: int = 300) -> DataFrame:
    """Carry out pending tasks with an external command on the executors; status becomes completed or error. A side effect, outside Catalyst:
    call it only where input and output paths are reachable from every executor."""

    def work(batches):
        import subprocess

        for pdf in batches:
            for i, row in pdf.iterrows():
                if row["status"] != "pending":
                    continue
                try:
                    done = subprocess.run([command, row["input_path"], row["output_path"]], capture_output=True, timeout=timeout, check=False)
                    pdf.loc[i, ["status", "error"]] = ("completed", "") if done.returncode == 0 else ("error", done.stderr.decode("utf-8", "ignore")[-500:])
                except (OSError, subprocess.TimeoutExpired) as problem:
                    pdf.loc[i, ["status", "error"]] = ("error", str(problem))
            yield pdf

    return tasks.mapInPandas(work, tasks.schema)
