"""CSV ingest (S1-S3, S9, S10, S12): file -> canonical issue rows -> table.

Spark's CSV reader handles quoted fields, doubled quotes, commas and
newlines inside quotes, CR/LF/CRLF and blank lines (``multiLine``); short
rows get nulls (PERMISSIVE).  Header names are normalized once (S2) and the
issue fields are resolved from Spanish / English aliases (N4).
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from defectlens.functions.text import normalize_header, sprint_number, split_tags
from defectlens.sources.aliases import ISSUE_ALIASES


def header_groups(spark: SparkSession, path, encoding: str = "UTF-8") -> list[list[str]]:
    """Files of a folder grouped by their header line (one pass over the first blocks).

    The first line of a file is its row with the least row id in the block
    that starts at 0.  The lists are bounded by the number of files.
    """
    lines = (spark.read.option("encoding", encoding).text(path)
             .select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
                     F.monotonically_increasing_id().alias("i")).filter("b = 0"))
    firsts = lines.groupBy("f").agg(F.min_by("value", "i").alias("header"))
    rows = firsts.groupBy("header").agg(F.sort_array(F.collect_list("f")).alias("files")).orderBy("header").collect()
    return [r.files for r in rows]


def read_issue_csv(spark: SparkSession, path, encoding: str = "UTF-8") -> DataFrame:
    """S1 + S2 + S3: every column a string, headers normalized, duplicate
    names suffixed ``_2``, ``_3``... (the dashboard would fail on them).

    Files with different headers are read apart, each by its own, and joined
    by column name.  Quoted newlines make a file one task (``multiLine``).
    """
    groups = header_groups(spark, path, encoding)
    if len(groups) <= 1:
        return _read_one_header(spark, path, encoding)
    out = None
    for files in groups:
        one = _read_one_header(spark, files, encoding)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def _read_one_header(spark: SparkSession, path, encoding: str) -> DataFrame:
    raw = (spark.read.option("header", True).option("multiLine", True).option("quote", '"')
           .option("escape", '"').option("mode", "PERMISSIVE").option("encoding", encoding)
           .option("inferSchema", False).csv(path))
    # Spark already de-duplicates repeated header names by appending the
    # column index; undo that so the S2 rule (``_2``, ``_3``) applies.
    cands = []
    for i, c in enumerate(raw.columns):
        s = str(i)
        cands.append(c[:-len(s)] if c.endswith(s) and len(c) > len(s) else None)
    dup = Counter(c.lower() for c in cands if c is not None)
    originals = [b if b is not None and dup[b.lower()] >= 2 else c for b, c in zip(cands, raw.columns)]
    seen: dict[str, int] = {}
    names = []
    for c in originals:
        n = normalize_header(c)
        seen[n] = seen.get(n, 0) + 1
        names.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return raw.toDF(*names).withColumn("source_file", F.col("_metadata.file_path"))


def canonical_issues(rows: DataFrame) -> DataFrame:
    """N4 + N16 + X7: CSV rows -> issue columns (first non-blank alias)."""
    present = set(rows.columns)
    out = []
    for name, chain in ISSUE_ALIASES.items():
        cols = [F.nullif(F.trim(F.col(a)), F.lit("")) for a in chain if a in present]
        v = F.coalesce(*cols) if cols else F.lit(None).cast("string")
        out.append((split_tags(v) if name == "tags" else v).alias(name))
    df = rows.select(*out)
    return df.withColumn("sprint_num", sprint_number(F.col("sprint")))


def load_log(rows: DataFrame, status: str = "success", notes: str = "") -> DataFrame:
    """One load-metadata row per source file (name, path, size, issue
    count, sprint count, status, notes, time) -- one aggregate pass."""
    return rows.groupBy(F.col("_metadata.file_path").alias("source_file_path"),
                        F.col("_metadata.file_name").alias("source_file_name"),
                        F.col("_metadata.file_size").alias("source_file_size")).agg(
        F.count(F.lit(1)).alias("total_bugs_loaded"),
        F.count_distinct(F.trim(F.col("sprint"))).alias("total_sprints_loaded"),
    ).withColumns({"status": F.lit(status), "notes": F.lit(notes), "load_timestamp": F.current_timestamp()})


def sprint_dimension(issues: DataFrame) -> DataFrame:
    """U6 + X7: distinct trimmed sprint labels with their number."""
    s = issues.select(F.trim(F.col("sprint")).alias("sprint")).filter(
        F.col("sprint").isNotNull() & (F.col("sprint") != "")).distinct()
    return s.withColumn("sprint_num", sprint_number(F.col("sprint")))


def upsert_dimension(current: DataFrame | None, new: DataFrame, key: str = "sprint") -> DataFrame:
    """``INSERT OR REPLACE`` on the key: union with a load sequence,
    keep the latest row per key (one shuffle on the key)."""
    n = new.withColumn("_seq", F.lit(1))
    if current is None:
        return new
    u = current.withColumn("_seq", F.lit(0)).unionByName(n, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc("_seq"))
    return u.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_seq")


#: Rows of one CSV file; a file with quoted line ends is read by one task.
CSV_ROWS = 100_000


def write_issue_csv(df: DataFrame, path: str, header_names: dict[str, str], mode: str = "overwrite") -> None:
    """CSV sink with custom header names (used to produce test inputs): gzip files of at most ``CSV_ROWS`` rows."""
    out = df.select(*[F.col(c).alias(h) for c, h in header_names.items()])
    out.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"') \
        .option("quoteAll", False).option("compression", "gzip").option("maxRecordsPerFile", CSV_ROWS).csv(path)
