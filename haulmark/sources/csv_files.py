"""The nine raw CSV files as lazy scans with pinned types."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulmark.schemas import SOURCE_FILES, SOURCE_TYPES

ORDINAL = ["_file", "_block", "_line"]

# Review comments are the only free text that may hold line breaks inside quotes.
MULTI_LINE = {"order_reviews"}


def _path(spark: SparkSession, root: str, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join([root.rstrip("/"), *parts]))


def missing_files(spark: SparkSession, root: str) -> list[str]:
    """Names of expected files that are absent; works on any Hadoop file system."""
    fs = _path(spark, root).getFileSystem(spark._jsc.hadoopConfiguration())
    return [f"{stem}.csv" for stem in SOURCE_FILES.values() if not fs.exists(_path(spark, root, f"{stem}.csv"))]


def check_complete(spark: SparkSession, root: str) -> None:
    fs = _path(spark, root).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(_path(spark, root)):
        raise FileNotFoundError(f"source folder not found: {root}")
    missing = missing_files(spark, root)
    if missing:
        raise FileNotFoundError(f"missing source files in {root}: {', '.join(missing)}")


def parts_of(spark: SparkSession, root: str, table: str) -> dict[str, int]:
    """The files of a table, one file or a folder of parts, with their sizes; nothing is opened."""
    path = _path(spark, root, f"{SOURCE_FILES[table]}.csv")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    statuses = fs.listStatus(path)  # of the file itself, or of the folder's entries
    named = ((status.getPath().toString(), status) for status in statuses)
    return {name: status.getLen() for name, status in named if status.isFile() and name.rpartition("/")[2][0] not in "._"}


def digests(spark: SparkSession, files: list[str]) -> dict[str, str]:
    """A digest of each file's lines, whatever their order; the files are read where they lie, one row each comes back."""
    if not files:
        return {}
    lines = spark.read.text(files).select(F.col("_metadata.file_path").alias("file"), F.xxhash64("value").alias("h"))
    sums = lines.groupBy("file").agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("sum"), F.count(F.lit(1)).alias("n"))
    found = {_plain(row.file): f"{row.n}:{row.sum}" for row in sums.collect()}
    return {file: found.get(_plain(file), "0:0") for file in files}


def _plain(path: str) -> str:
    """A path without its scheme, so that two spellings of it compare."""
    return "/" + unquote(path.partition(":")[2] if ":" in path else path).lstrip("/")


def read_table(
    spark: SparkSession, root: str, table: str, mode: str = "FAILFAST", ordinal: bool = False, files: list[str] | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """One CSV file (or folder of parts, or the given ``files`` of it) with its pinned types; other columns stay text.

    FAILFAST stops at a value that does not fit its pinned type; PERMISSIVE nulls it and keeps
    the line in ``_corrupt_record``. ``ordinal`` adds sortable columns that follow file order
    however the file is split. A file that may hold line breaks inside quotes, by default only ``MULTI_LINE``, is
    read by one task; say ``multi_line=False`` if it holds none, and it is split like any other.
    """
    path = files or f"{root.rstrip('/')}/{SOURCE_FILES[table]}.csv"
    options = {"header": "true", "quote": '"', "escape": '"', "multiLine": str(table in MULTI_LINE if multi_line is None else multi_line).lower()}
    header = spark.read.options(**options).csv(path).columns
    pinned = SOURCE_TYPES[table]
    absent = [name for name in pinned if name not in header]
    if absent:
        raise ValueError(f"{path} lacks columns {', '.join(absent)}")
    ddl = ", ".join(f"`{name}` {pinned.get(name, 'string')}" for name in header)
    schema = T.StructType.fromDDL(ddl)
    if mode.upper() == "PERMISSIVE":
        schema = schema.add("_corrupt_record", T.StringType())
    df = spark.read.options(**options).option("mode", mode).schema(schema).csv(path)
    if ordinal:
        # A block is read front to back by one task, so its running id follows its lines.
        df = df.select(
            "*",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_line"),
        )
    return df


def read_sources(
    spark: SparkSession, root: str, mode: str = "FAILFAST", multi_line: bool | None = None
) -> dict[str, DataFrame]:
    """All nine tables; orders carry the file-order columns ``ORDINAL`` for keep-first."""
    check_complete(spark, root)
    return {
        table: read_table(spark, root, table, mode, ordinal=table == "orders", multi_line=multi_line) for table in SOURCE_FILES
    }
