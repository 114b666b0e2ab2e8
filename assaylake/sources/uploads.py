"""Uploaded CSV files of experiments.

A ledger holds the digest of every file that was taken, so a file counts once, whatever
its name and however often it arrives.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.checks import failed
from ..operators.experiments import EXPERIMENT_TYPES, check_rows
from ..session import cut, discard

BAD = "_bad"
ENDING = "*.[cC][sS][vV]"
_LEDGER = "batch int, digest string, path string, file_name string, status string"
NEW, REPEATED, REJECTED = "new", "repeated", "not_csv"


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all CSV files below `path` as text fields, with the name of their file.

    Files of other kinds are not opened. Lines with missing or surplus fields keep their
    text in `_bad`. Fields are read as text because the reader converts, and so checks, only
    the columns a query selects.
    """
    fields = [T.StructField(name, T.StringType()) for name in [*schemas.UPLOAD.names, BAD]]
    lines = (
        spark.read.schema(T.StructType(fields))
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD)
        .option("pathGlobFilter", ENDING)
        .option("recursiveFileLookup", True)
        .csv(path)
    )
    return lines.select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("path"))


def check_lines(lines: DataFrame, types: tuple[str, ...] = EXPERIMENT_TYPES) -> DataFrame:
    """Every line as text in `_line`, with `errors`.

    The rules are those of `check_rows`; a line with missing or surplus fields fails as a
    whole. A line that is no experiment at all is not tried field by field.
    """
    whole = F.col(BAD).isNull()
    extra = {"line_incomplete": ~whole}
    for field in schemas.UPLOAD:
        if field.name in ("user_id", "success"):
            text = F.trim(f"_line.{field.name}")
            extra[f"{field.name}_unreadable"] = whole & (text != "") & text.try_cast(field.dataType).isNull()
    checked = check_rows(lines.withColumn("_line", F.struct(*lines.columns)), types)
    errors = F.concat(failed(extra), F.when(whole, F.col("errors")).otherwise(F.array().cast("array<string>")))
    return checked.select("_line", errors.alias("errors"))


def split_lines(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(typed experiment rows, rejected lines as text with their error codes) of `check_lines`."""
    typed = {
        field.name: F.trim(field.name).try_cast(field.dataType)
        for field in schemas.UPLOAD if not isinstance(field.dataType, T.StringType)
    }
    good = checked.filter(F.size("errors") == 0).select("_line.*").withColumns(typed).drop(BAD)
    return good, checked.filter(F.size("errors") > 0).select("_line.*", "errors")


def process_uploads(
    lines: DataFrame, types: tuple[str, ...] = EXPERIMENT_TYPES
) -> tuple[DataFrame, DataFrame]:
    """(typed experiment rows, rejected lines as text with their error codes)."""
    return split_lines(check_lines(lines, types))


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """Every file of every intake below `root`: batch, digest, path, file_name, status."""
    try:
        return spark.read.schema(_LEDGER).parquet(f"{root}/ledger")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LEDGER)  # nothing was taken yet


def classify_files(spark: SparkSession, path: str, taken: DataFrame) -> DataFrame:
    """digest, path, file_name, status of all files below `path`.

    A CSV file is `new` if no digest in `taken` equals its own and no equal file sorts before
    it by path; else it is `repeated`. Files of other kinds are `not_csv`; their content is
    not read, and they have no digest. Paths and names are percent-encoded, as Spark gives them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    name = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name")]
    csv = files.option("pathGlobFilter", ENDING).load(path).select(F.sha2("content", 256).alias("digest"), *name)
    every = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*").load(path)
    other = every.select(F.lit(None).cast("string").alias("digest"), *name).filter(
        ~F.lower("file_name").endswith(".csv")
    )
    known = taken.filter(F.col("status") == NEW).select("digest", F.lit(True).alias("known"))
    earlier = F.row_number().over(Window.partitionBy("digest").orderBy("path")) > 1
    status = F.when(F.col("known") | earlier, REPEATED).otherwise(NEW)
    judged = csv.join(known, "digest", "left").select("digest", "path", "file_name", status.alias("status"))
    return judged.unionByName(other.withColumn("status", F.lit(REJECTED)))


def ingest_uploads(
    spark: SparkSession, path: str, root: str, types: tuple[str, ...] = EXPERIMENT_TYPES
) -> int:
    """Take the new files below `path`; returns the number of the intake.

    Typed rows go to rows/batch=<n>, rejected lines to rejected/batch=<n>, and last the files
    to ledger/batch=<n>: an intake that died before that is done again under its own number
    and replaces what it left. One intake at a time.
    """
    seen = ledger(spark, root)
    number = 1 + (seen.agg(F.max("batch")).first()[0] or 0)
    files = cut(classify_files(spark, path, seen))
    stored = [files]
    try:
        new = files.filter(F.col("status") == NEW).select("path")
        # Files are parsed and checked once, not once for either kind of row.
        checked = cut(check_lines(read_uploads(spark, path).join(new, "path", "left_semi"), types))
        stored.append(checked)
        good, bad = split_lines(checked)
        good.write.mode("overwrite").parquet(f"{root}/rows/batch={number}")
        bad.write.mode("overwrite").parquet(f"{root}/rejected/batch={number}")
        files.write.mode("overwrite").parquet(f"{root}/ledger/batch={number}")
    finally:
        discard(*stored)
    return number


def write_template(spark: SparkSession, path: str) -> None:
    """The expected layout as a CSV file with the header line only."""
    spark.createDataFrame([], schemas.UPLOAD).coalesce(1).write.option("header", True).csv(path)
