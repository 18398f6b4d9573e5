"""JSON documents (S4-S6, S11): the dashboard's whole-document format.

``read_documents`` parses one document per file with a fixed schema
(multiLine, PERMISSIVE): a malformed file becomes one row whose
``_corrupt_record`` is set and is routed to quarantine instead of silently
becoming an empty record.  ``sections`` turns the nested record into flat
frames (summary, sprints with array position, developers, maps exploded).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from defectlens.operators.rollups import join_null_safe
from defectlens.session import scratch_path
from defectlens.sources.aliases import (DEVELOPER_ALIASES, DEVELOPER_TEXT, SPRINT_ALIASES, SPRINT_TEXT,
                                         resolve)

L, S, D = T.LongType(), T.StringType(), T.DoubleType()


def _struct(names, typ_for):
    return T.StructType([T.StructField(n, typ_for(n)) for n in names])


_SPRINT_FIELDS = sorted({a for chain in SPRINT_ALIASES.values() for a in chain})
_SPRINT_STR = {a for k in SPRINT_TEXT for a in SPRINT_ALIASES[k]} - {"sprint_num", "total"}
_DEV_FIELDS = sorted({a for chain in DEVELOPER_ALIASES.values() for a in chain} | {"totalBugs"})
_DEV_STR = {a for k in DEVELOPER_TEXT for a in DEVELOPER_ALIASES[k]}

COUNTS = T.StructType([T.StructField("count", L), T.StructField("percentage", L), T.StructField("pending", L),
                       T.StructField("resolved", L)])

DOC_SCHEMA = T.StructType([
    T.StructField("metadata", T.StructType([T.StructField("lastUpdated", S), T.StructField("source", S),
                                            T.StructField("version", S),
                                            T.StructField("sprints", T.ArrayType(S))])),
    T.StructField("summary", T.StructType([T.StructField(n, L) for n in (
        "totalBugs", "bugsClosed", "bugsPending", "testCasesTotal", "testCasesExecuted", "testCasesPassed",
        "testCasesFailed")])),
    T.StructField("bugsByPriority", T.MapType(S, COUNTS)),
    T.StructField("bugsByModule", T.MapType(S, COUNTS)),
    T.StructField("developerData", T.ArrayType(_struct(_DEV_FIELDS, lambda n: S if n in _DEV_STR else D))),
    T.StructField("sprintData", T.ArrayType(_struct(_SPRINT_FIELDS, lambda n: S if n in _SPRINT_STR else D))),
    T.StructField("bugsByCategory", T.MapType(S, COUNTS)),
    T.StructField("qualityMetrics", T.StructType([T.StructField("testAutomation", D),
                                                  T.StructField("cycleTime", D)])),
    T.StructField("recommendations", T.MapType(S, T.ArrayType(S))),
    T.StructField("productionBugs", L),
    T.StructField("reworkBugs", L),
    T.StructField("bugResolutionTimes", T.ArrayType(D)),
    T.StructField("_corrupt_record", S),
])


def read_documents(spark: SparkSession, path, multi_line: bool = True, labels: str = "") -> DataFrame:
    """S4 + S6: one row per document (a pretty-printed file holds one
    document: ``multi_line``; JSON Lines written by ``write_documents`` hold
    one per line), with its file path and mtime; ``labels`` are columns that
    the folder names give (``kind=a/...``)."""
    schema = T.StructType([*DOC_SCHEMA.fields, *(T.StructType.fromDDL(labels).fields if labels else [])])
    df = (spark.read.schema(schema).option("multiLine", multi_line).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    return df.withColumns({"doc_path": F.col("_metadata.file_path"),
                           "doc_mtime": F.col("_metadata.file_modification_time")})


def split_corrupt(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good documents, quarantined documents).

    Spark only lets a query read the corrupt-record column together with
    the parsed result, so the parsed documents are written once below
    ``spark.checkpoint.dir`` and both outputs are taken from that copy.
    """
    path = scratch_path(docs.sparkSession, "parsed-documents")
    docs.write.parquet(path)
    parsed = docs.sparkSession.read.schema(docs.schema).parquet(path)
    bad = F.col("_corrupt_record").isNotNull()
    return parsed.filter(~bad), parsed.filter(bad).select("doc_path", "_corrupt_record")


def sprint_rows(docs: DataFrame, key: str = "doc_path") -> DataFrame:
    """S5 + N1 + N6: sprint records with canonical names; ``sprint_num`` is
    the array position + 1 (order matters); missing labels -> ``Sprint n``."""
    x = docs.select(key, F.posexplode_outer("sprintData").alias("pos", "s")).filter(F.col("s").isNotNull())
    present = set(_SPRINT_FIELDS)
    cols = resolve(present, SPRINT_ALIASES, SPRINT_TEXT, prefix="s.")
    y = x.select(key, (F.col("pos") + 1).cast("int").alias("sprint_num"), *cols)
    return y.withColumn("sprint", F.coalesce(F.nullif(F.col("sprint"), F.lit("")),
                                             F.concat(F.lit("Sprint "), F.col("sprint_num").cast("string"))))


def developer_rows(docs: DataFrame, key: str = "doc_path") -> DataFrame:
    """S5 + N2: developer records with canonical names."""
    x = docs.select(key, F.explode_outer("developerData").alias("d")).filter(F.col("d").isNotNull())
    return x.select(key, *resolve(set(_DEV_FIELDS), DEVELOPER_ALIASES, DEVELOPER_TEXT, prefix="d."))


def map_rows(docs: DataFrame, field: str, key: str = "doc_path") -> DataFrame:
    """A breakdown map exploded to (key, count, percentage, pending, resolved)."""
    return docs.select(key, F.explode_outer(field).alias("label", "v")).filter(F.col("label").isNotNull()) \
        .select(key, "label", "v.count", "v.percentage", "v.pending", "v.resolved")


def summary_row(docs: DataFrame, critical_labels, all_critical_labels, key: str = "doc_path") -> DataFrame:
    """Summary record of each document in the sprint roll-up's column names
    (for ``kpis.kpis(summary=...)``): totals, priority-derived critical counts,
    production / rework bugs, positive resolution times, automation."""
    prio = F.col("bugsByPriority")

    def sum_labels(labels, field):
        return F.coalesce(F.aggregate(F.array(*[F.coalesce(prio[l][field], F.lit(0)) for l in labels]),
                                      F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0))
    times = F.filter(F.coalesce(F.col("bugResolutionTimes"), F.array().cast("array<double>")), lambda t: t > 0)
    return docs.select(
        key,
        F.coalesce(F.col("summary.totalBugs"), F.lit(0)).alias("bugs"),
        F.coalesce(F.col("summary.bugsClosed"), F.lit(0)).alias("bugs_resolved"),
        F.coalesce(F.col("summary.testCasesTotal"), F.lit(0)).alias("test_planned"),
        F.coalesce(F.col("summary.testCasesExecuted"), F.lit(0)).alias("test_cases"),
        F.coalesce(F.col("summary.testCasesPassed"), F.lit(0)).alias("tc_passed"),
        F.coalesce(F.col("productionBugs"), F.lit(0)).alias("production_bugs"),
        F.coalesce(F.col("reworkBugs"), F.lit(0)).alias("reopened"),
        sum_labels(all_critical_labels, "count").alias("crit_all"),
        sum_labels(critical_labels, "count").alias("critical_total"),
        sum_labels(critical_labels, "pending").alias("crit_pending_view"),
        F.aggregate(times, F.lit(0.0), lambda a, b: a + b).alias("res_days_sum"),
        F.size(times).cast("long").alias("res_days_n"),
        F.col("qualityMetrics.testAutomation").alias("test_automation"),
    )


def write_documents(docs: DataFrame, path: str) -> None:
    """JSON sink, one line per document."""
    docs.write.mode("overwrite").json(path)


def latest_document(spark: SparkSession, folder: str) -> DataFrame:
    """The newest ``*.json`` in a folder by modification time (file
    metadata only; ``max_by`` over the listing, no content read)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder) \
        .select("path", "modificationTime")
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"),
                     F.max("modificationTime").alias("modificationTime"))


def with_section(docs: DataFrame, section: DataFrame, by: list[str]) -> DataFrame:
    """Attach one-row-per-group sections; without keys the single row comes as a scalar subquery."""
    if by:
        return join_null_safe(docs, section, by)
    one = section.select(F.struct(*section.columns).alias("_s")).scalar()
    return docs.withColumns({c: one[c] for c in section.columns})


def issues_to_documents(sprints: DataFrame, by: list[str], priority: DataFrame | None = None) -> DataFrame:
    """S11 producer: one nested document per group: summary totals and the
    ordered ``sprintData`` array (one element per sprint, so the array is
    bounded by the number of sprints, not issues), plus ``bugsByPriority``."""
    s = sprints
    elem = F.struct(F.col("sprint_num").alias("_ord"), F.col("sprint").alias("sprint"),
                    F.col("bugs").cast("double").alias("bugs"),
                    F.col("bugs_resolved").cast("double").alias("bugsResolved"),
                    F.col("bugs_pending").cast("double").alias("bugsPending"),
                    F.col("test_cases").cast("double").alias("testCases"),
                    F.col("test_planned").cast("double").alias("testPlanned"),
                    F.col("velocity").cast("double").alias("velocity"),
                    F.col("planned_velocity").cast("double").alias("plannedVelocity"))
    docs = s.groupBy(*by).agg(
        F.struct(F.sum("bugs").cast("long").alias("totalBugs"), F.sum("bugs_resolved").cast("long").alias("bugsClosed"),
                 F.sum("bugs_pending").cast("long").alias("bugsPending"),
                 F.sum("test_planned").cast("long").alias("testCasesTotal"),
                 F.sum("test_cases").cast("long").alias("testCasesExecuted"),
                 F.sum("tc_passed").cast("long").alias("testCasesPassed")).alias("summary"),
        F.transform(F.array_sort(F.collect_list(elem)), lambda e: e.dropFields("_ord")).alias("sprintData"),
    )
    if priority is not None:
        pm = priority.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(
            "priority", F.struct(F.col("count").cast("long").alias("count"),
                                 F.col("pending").cast("long").alias("pending"))))).alias("bugsByPriority"))
        docs = with_section(docs, pm, by)
    return docs
