"""Readers and writers; every reader takes its schema or the file's own, none infers from data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The literals that count as a missing description.
NULL_LITERALS = ["", "null", "none", "nan"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table as a file stream, whether it is one file or a folder of them; without a limit its files are one micro-batch.

    The path is a pattern that only the table fits: a file source takes a plain path for a folder, and a filter by name
    would see the names of the files in the folder.
    """
    stream = spark.readStream.schema(table(spark, sf_dir, name).schema)
    stream = stream if files_per_trigger is None else stream.option("maxFilesPerTrigger", files_per_trigger)
    return stream.parquet(f"{sf_dir}/{name}.parque[t]")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, quoted line breaks and a declared schema."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)


def read_csv_rows(spark: SparkSession, path: str, columns: list[str], required: str, limit: int | None = None) -> DataFrame:
    """All-string CSV rows, trimmed, without those whose ``required`` column holds a null literal."""
    rows = read_csv(spark, path, ", ".join(f"`{c}` string" for c in columns)).select(*[F.trim(c).alias(c) for c in columns])
    rows = rows.where(~is_null_literal(F.col(required)))
    return rows if limit is None else rows.limit(limit)


def is_null_literal(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)), F.lit("")).isin(NULL_LITERALS)


def read_json_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of JSON files, each an object or an array of objects; broken files give no row."""
    held = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("pathGlobFilter", "*.json")
    rows = held.schema(f"{schema}, _broken string").json(path)
    return rows.where("_broken IS NULL").drop("_broken")


def read_reference_list(spark: SparkSession, path: str, field: str, lines: bool = False) -> DataFrame:
    """(name): the distinct names under ``field`` of saved answers, a folder whose files (with ``lines``, whose lines)
    are JSON arrays or objects each; broken ones give no name.

    Names are trimmed; null literals are no names, and names that differ in case only are one, in lower case.
    """
    name = F.lower(F.trim(F.col(f"`{field}`")))
    rows = spark.read.schema(f"`{field}` string").json(path) if lines else read_json_folder(spark, path, f"`{field}` string")
    return rows.where(~is_null_literal(F.col(f"`{field}`"))).select(name.alias("name")).distinct()


def read_metric_lines(spark: SparkSession, path: str) -> DataFrame:
    """``key: value`` lines of text reports as (key, value)."""
    lines = spark.read.text(path)
    return lines.select(F.trim(F.regexp_extract("value", r"^([^:]+):", 1)).alias("key"), F.expr("try_cast(regexp_extract(value, '^[^:]+: *([-+0-9.eE]+)', 1) AS double)").alias("value")).where("value IS NOT NULL")


def read_results(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """The union of all result files that match a pattern."""
    return spark.read.option("multiLine", True).schema(schema).json(pattern)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


#: Single records that a task writes; opening a file takes most of the time.
RECORDS_A_TASK = 1_000


def write_json_records(df: DataFrame, folder: str, by: str, key: str) -> None:
    """One JSON file a row, in a folder for each ``by`` and ``key``, and all rows once more in ``<folder>/all``.

    A file a row is what the consumers of single records read; everything else should read ``all``. Rows are dealt to
    all cores, as a table of few row groups would have its files opened by one or two tasks.
    """
    named = df.withColumn("__by", F.col(by)).withColumn("__key", F.regexp_replace(F.col(key).cast("string"), "[^A-Za-z0-9._-]+", "_"))
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // RECORDS_A_TASK))
    named = named.repartition(min(tasks, 10_000), "__by", "__key")
    named.write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy("__by", "__key").json(f"{folder}/records")
    df.write.mode("overwrite").json(f"{folder}/all")


def url_tail(url: Column) -> Column:
    """The last part of a URL's path, without query, fragment and closing slash; '' where there is none."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*", 0)
    return F.regexp_extract(F.regexp_replace(path, "/+$", ""), r"^.*?://[^/]*/.*?([^/]+)$", 1)


def read_json_records(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The single records of ``write_json_records`` with the file that each came from."""
    return spark.read.schema(f"{schema}, __by string, __key string").json(f"{folder}/records").withColumn("file", F.input_file_name()).drop("__by", "__key")


def write_metrics(df: DataFrame, path: str) -> DataFrame:
    """Metrics as CSV with four decimal places and a header, and as JSON beside it; the CSV as it reads back, all strings."""
    four = [F.format_string("%.4f", F.col(c)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes]
    write_csv(df.select(*four), f"{path}/csv")
    write_json(df, f"{path}/json")
    return read_csv(df.sparkSession, f"{path}/csv", ", ".join(f"`{c}` string" for c in df.columns))


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The columns that a CSV folder's first line names."""
    return spark.read.option("header", True).option("escape", '"').csv(path).columns


def write_ordered(df: DataFrame, path: str, suffixes: list[str]) -> None:
    """A CSV whose columns stand without a suffix first, then by suffix."""
    write_csv(df.select(*[F.col(f"`{c}`") for c in ordered_by_suffix(df.columns, suffixes)]), path)


def digest(df: DataFrame) -> tuple[int, int]:
    """(rows, sum of the rows' hashes), whatever their order; floats and nested columns count as their JSON."""
    h = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}))
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return int(row.n), int(row.h)


def write_parquet_checked(df: DataFrame, path: str) -> int:
    """Write under a new path, read back, and return the row count; a difference is an error."""
    df.write.mode("errorifexists").parquet(path)
    back = df.sparkSession.read.parquet(path)
    written, expected = back.count(), df.count()
    if written != expected:
        raise OSError(f"{path} holds {written} of {expected} rows")
    return written


def replace_checked(df: DataFrame, path: str) -> str | None:
    """Replace the table at ``path`` and keep the one before; the backup's path, or None if there was none.

    The new rows are written beside it and read back first; only if their number and content agree is the old folder
    renamed to ``<path>.backup-<n>`` and the new one put in its place. A failure leaves the old table where it was.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    of = jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(conf)
    staged = f"{path}.new"
    df.write.mode("overwrite").parquet(staged)
    if digest(spark.read.schema(df.schema).parquet(staged)) != digest(df):
        raise OSError(f"{staged} does not hold what was written")
    backup = None
    if fs.exists(of(path)):
        number = 1
        while fs.exists(of(f"{path}.backup-{number}")):
            number += 1
        backup = f"{path}.backup-{number}"
        if not fs.rename(of(path), of(backup)):
            raise OSError(f"{path} can't be renamed to {backup}")
    if not fs.rename(of(staged), of(path)):
        raise OSError(f"{staged} can't be renamed to {path}")
    return backup


def ordered_by_suffix(columns: list[str], suffixes: list[str]) -> list[str]:
    """Columns without any of the suffixes first, then by suffix in the given order."""
    rank = lambda c: next((i + 1 for i, s in enumerate(suffixes) if c.endswith(s)), 0)
    return sorted(columns, key=lambda c: (rank(c), columns.index(c)))
