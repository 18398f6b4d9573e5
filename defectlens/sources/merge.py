"""Combining alternative sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from defectlens.operators.numbering import positions
from defectlens.sources.aliases import MODULE_ALIASES


def fallback(primary: DataFrame, derived: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``primary``, plus the rows of ``derived`` whose key the
    primary lacks (``left_anti`` on the key, then ``unionByName``)."""
    extra = derived.join(primary.select(*key).distinct(), key, "left_anti")
    return primary.unionByName(extra, allowMissingColumns=True)


def union_by_priority(sources: list[tuple[str, DataFrame]], key: list[str]) -> DataFrame:
    """One row per key from the first source (in list order) having it:
    ``unionByName(allowMissingColumns)`` + ``row_number`` by source rank."""
    u = None
    for rank, (name, df) in enumerate(sources):
        d = df.withColumn("_src_rank", F.lit(rank)).withColumn("source", F.lit(name))
        u = d if u is None else u.unionByName(d, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy("_src_rank")
    return u.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_src_rank")


def default_if_empty(df: DataFrame, defaults: DataFrame) -> DataFrame:
    """``df`` if it has rows, else the all-zero default record (the
    emptiness test is a scalar subquery, evaluated once, no driver collect)."""
    empty = df.select((F.count(F.lit(1)) == 0).alias("e")).scalar()
    return df.unionByName(defaults.filter(empty), allowMissingColumns=True)


def pick_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """Keep the listed fields that exist."""
    return df.select(*[c for c in fields if c in df.columns])


def view_sprint_rows(rows: DataFrame, label_cols=("sprint", "sprint_name"), num_cols=("sprint_num", "sprint_number"),
                     order_col: str | list[str] | None = None) -> DataFrame:
    """Sprint rows from a view: number = first parsable of the number
    columns, else the row position (by ``order_col``, numbered in two passes
    without one task; give columns that settle ties); numeric fields made safe
    (``try_cast`` to double, non-numbers -> 0)."""
    present = set(rows.columns)
    nums = [F.col(c).cast("string").try_cast("int") for c in num_cols if c in present]
    if not nums and not order_col:
        raise ValueError("rows without a number column need order_col for their position")
    if order_col:
        rows = positions(rows, [order_col] if isinstance(order_col, str) else order_col, column="_place")
    pos = (F.col("_place") + 1).cast("int") if order_col else F.lit(None).cast("int")
    labels = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in label_cols if c in present]
    out = rows.withColumn("sprint_num", F.coalesce(*nums, pos) if nums else pos).drop("_place")
    return out.withColumn("sprint", F.coalesce(*labels, F.concat(F.lit("Sprint "),
                                                                F.col("sprint_num").cast("string"))))


def safe_number(c: Column, default: float = 0.0) -> Column:
    """Finite number or the default."""
    v = c.cast("string").try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(default)).otherwise(v)


def module_rows(docs: DataFrame, key: str = "doc_path", field: str = "bugsByModule") -> DataFrame:
    """Module breakdown map -> (module, total, pending, resolved,
    percentage) with the first truthy alias per field."""
    x = docs.select(key, F.explode_outer(field).alias("module", "v")).filter(F.col("module").isNotNull())
    names = set(x.select("v.*").columns)
    out = [key, "module"]
    for canon, chain in MODULE_ALIASES.items():
        cols = [F.nullif(F.col(f"v.{a}"), F.lit(0)) for a in chain if a in names]
        out.append(F.coalesce(*cols, F.lit(0)).cast("long").alias(canon))
    return x.select(*out)


def sprints_for_test_type(sprints: DataFrame, labels: DataFrame, test_type: str,
                          type_col: str = "test_type") -> DataFrame:
    """Sprint records of the requested test type among selected labels."""
    return sprints.filter(F.col(type_col) == test_type).join(labels.select("sprint").distinct(), "sprint", "inner")


def read_sql_table(spark: SparkSession, name: str | None = None, jdbc_url: str | None = None,
                   table: str | None = None, properties: dict | None = None) -> DataFrame:
    """A catalog table (``spark.table``) or an external SQL table read
    through JDBC (needs the driver jar on the classpath)."""
    if name:
        return spark.table(name)
    return spark.read.jdbc(jdbc_url, table, properties=properties or {})


def json_field(col: Column, field: str, typ: str = "double") -> Column:
    """One field of a JSON text column (``from_json`` with a one-field
    schema, so only that field is materialized)."""
    return F.from_json(col, f"{field} {typ}")[field]


def display_date(col: Column) -> Column:
    """``MM/dd/yyyy HH:mm``."""
    return F.date_format(col, "MM/dd/yyyy HH:mm")
