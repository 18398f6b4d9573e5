"""CSV files with a header each (S1-S3, N4): cells first, names by a table of headers.

A folder of uploads mixes files with other columns, orders and languages.  The
files are read once, as rows of unnamed cells; the first row of a file is its
header.  The headers form a table (file, normalized names); a row's fields are
its cells at the places where its own file's header has an alias of the field.
So any number of different headers is one plan, in batch and inside a stream's
micro-batch, and no header passes through the driver.

Files whose header names no issue field at all, or has more than
``MAX_COLUMNS`` cells, are rejected whole and listed with the reason.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from defectlens.functions.text import split_tags, sprint_number
from defectlens.session import scratch_path
from defectlens.sources.aliases import ISSUE_ALIASES

#: Cells read of a row.
MAX_COLUMNS = 100

#: Cells of a row that are tried first (``land_cells``).
COMMON_COLUMNS = 24

_ALIASES = sorted({a for chain in ISSUE_ALIASES.values() for a in chain})


def _options(reader, encoding: str, columns: int):
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(columns)])
    return (reader.schema(schema).option("header", False).option("multiLine", True).option("quote", '"')
            .option("escape", '"').option("mode", "PERMISSIVE").option("encoding", encoding))


def _cells(raw: DataFrame, width: int) -> DataFrame:
    return raw.select(F.col("_metadata.file_path").alias("file"), F.array(*raw.columns[:width]).alias("cells"))


def read_cells(spark: SparkSession, path, encoding: str = "UTF-8", columns: int = MAX_COLUMNS) -> DataFrame:
    """All rows of the files, headers included: file, cells (one more than ``columns``)."""
    return _cells(_options(spark.read, encoding, columns + 1).csv(path), columns + 1)


def _read_narrow(spark: SparkSession, path, encoding: str, width: int) -> DataFrame:
    """``read_cells`` of rows that have at most ``width`` cells; a row of more ends the job.

    One more column is named than read, so the parser is told which to select
    and gives rows of that length; without, Spark throws and catches an
    exception for every cell that a row lacks.  A parser that selects misreads
    quoted cells of other columns (SPARK-46862); with ``maxColumns`` there are none.
    """
    raw = _options(spark.read, encoding, width + 1).option("columnPruning", True).option("maxColumns", width).csv(path)
    return _cells(raw, width)


def land_cells(spark: SparkSession, path, land: Callable[[DataFrame], DataFrame], encoding: str = "UTF-8",
               columns: int = MAX_COLUMNS) -> DataFrame:
    """``in_file_order`` rows of the files as ``land`` writes and reads them again.

    The cells are those of ``read_cells``; where no row has more than
    ``COMMON_COLUMNS`` or ``columns`` + 1 cells, only so many are kept, as the
    others are null.  ``land`` replaces what an attempt before has left.
    """
    for width in sorted({min(COMMON_COLUMNS, columns + 1), columns + 1}):
        try:
            return land(in_file_order(_read_narrow(spark, path, encoding, width)))
        except Exception as e:
            if not any(w in str(e) for w in ("TextParsingException", "FAILED_READ_FILE")):
                raise
    return land(in_file_order(read_cells(spark, path, encoding, columns)))


def stream_files(spark: SparkSession, path: str, max_files: int) -> DataFrame:
    """The files of a drop folder as a stream of their paths (their bytes are not read); ``file_list`` names those of a micro-batch."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", max_files).load(path).select("path")


def file_list(batch: DataFrame) -> list[str]:
    """Paths of a micro-batch of ``stream_files`` as a reader takes them: no character is a pattern."""
    return sorted(re.sub(r"([{}\[\]*?\\])", r"\\\1", r.path) for r in batch.collect())


def in_file_order(cells: DataFrame) -> DataFrame:
    """Rows with ``row``, rising within each file: a file with quoted line ends is read by one task, from its start.

    Write the result before its first rows are looked for, so that the files
    are parsed once and the numbers stay.
    """
    return cells.withColumn("row", F.monotonically_increasing_id())


def _names(cells: Column) -> Column:
    """Trimmed, lower case, runs of other than a-z0-9 to ``_``; repeated names get ``_2``, ``_3``."""
    plain = F.transform(cells, lambda c: F.regexp_replace(
        F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")), "[^a-z0-9]+", "_"))

    def numbered(all_names: Column) -> Column:
        def one(name: Column, i: Column) -> Column:
            before = F.size(F.filter(F.slice(all_names, F.lit(1), i), lambda x: x == name))
            return F.when(before == 0, name).otherwise(F.concat(name, F.lit("_"), (before + 1).cast("string")))
        return F.transform(all_names, one)

    # bound once, so that the names are not normalized again for each of their neighbours
    return F.flatten(F.transform(F.array(plain), numbered))


def _in_scratch(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"csv-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def file_headers(rows: DataFrame, columns: int = MAX_COLUMNS, land: Callable[[DataFrame, str], DataFrame] = _in_scratch) -> DataFrame:
    """The header table of ``in_file_order`` rows: file, first (its row), names, and the reason of a rejection or null.

    ``land`` writes a table of one row a file under a name and reads it again:
    with a measured size, joins with the cells broadcast it if it is small,
    and the cells are neither sorted nor shuffled.
    """
    least = land(rows.groupBy("file").agg(F.min("row").alias("first")), "firsts")
    first = rows.join(least.withColumnRenamed("file", "_file"), (F.col("file") == F.col("_file")) & (F.col("row") == F.col("first"))) \
        .select("file", "cells", "first")
    wide = F.get("cells", F.lit(columns)).isNotNull()
    missing = F.array_repeat(F.lit(None).cast("string"), F.lit(columns + 1) - F.size("cells"))
    named = first.withColumn("names", _names(F.concat("cells", missing)))
    known = F.arrays_overlap("names", F.array(*[F.lit(a) for a in _ALIASES]))
    reason = F.when(wide, f"more than {columns} columns").when(~known, "no issue field in the header")
    return land(named.select("file", "first", "names", reason.alias("reason")), "headers")


def rejected_files(headers: DataFrame) -> DataFrame:
    return headers.filter(F.col("reason").isNotNull()).select("file", "reason", F.array_join("names", ",").alias("header"))


def issues_of(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Canonical issues (as ``csv_source.canonical_issues``) of all rows below an accepted header, with ``source_file``.

    The first non-blank alias of a field counts.  Places are looked up once a
    header; the header table has a row a file and is joined by it.
    """
    place = {a: f"_at_{i}" for i, a in enumerate(_ALIASES)}
    places = headers.filter(F.col("reason").isNull()).select(
        F.col("file").alias("_file"), F.col("first").alias("_first"),
        *[(F.array_position("names", a) - 1).cast("int").alias(p) for a, p in place.items()])
    body = rows.join(places, F.col("file") == F.col("_file")).filter(F.col("row") > F.col("_first"))
    out = []
    for name, chain in ISSUE_ALIASES.items():
        found = [F.when(F.col(place[a]) >= 0, F.nullif(F.trim(F.get("cells", F.col(place[a]))), F.lit(""))) for a in chain]
        v = F.coalesce(*found)
        out.append((split_tags(v) if name == "tags" else v).alias(name))
    return body.select(*out, F.col("file").alias("source_file")).withColumn("sprint_num", sprint_number(F.col("sprint")))

