"""One roll-up cube from which every part of a report is derived.

One ``GROUPING SETS`` aggregation reads the issues once and counts them, per
group, by sprint, by assignee, by module and by priority.  Spark multiplies
the rows by the four sets in memory and combines them map-side, so the shuffle
carries a row per task and label.  The cube is written once below
``spark.checkpoint.dir``, a folder per set, and each part reads its own set
only; its size is groups x labels, whatever the number of issues.

Edge cases: null groups and labels are groups and labels of their own (the
grouping id tells them from the labels that a set leaves out); blank
assignees are left out and blank modules get the default label where a part
is read, not before; no issues give no rows; other columns are not read, and
no name of theirs clashes, as the cube's labels are prefixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defectlens import config as C
from defectlens.functions import label_or, pct
from defectlens.operators import rollups as R
from defectlens.operators.sprints import _sprint_exprs
from defectlens.session import scratch_path

SETS = {"sprint": ("sprint", "sprint_num"), "assignee": ("assignee",), "module": ("module",), "priority": ("priority",)}
_LABELS = ("sprint", "sprint_num", "assignee", "module", "priority")
_READ = ("status", "priority", "environment", "cases_executed", "cases_planned", "resolved_at", "created_at")


def _set_id(name: str) -> int:
    """``grouping_id`` of a set: a bit, most significant first, for each label that it leaves out."""
    return sum(1 << (len(_LABELS) - 1 - i) for i, c in enumerate(_LABELS) if c not in SETS[name])


def cube_frame(issues: DataFrame, by=None, cfg: C.Config | None = None, done_status: str = "Done") -> DataFrame:
    """``set``, the groups as k0.., the labels as d_..., and the counters of the sprint roll-up plus ``pending``."""
    cfg = cfg or C.Config()
    aggs, _ = _sprint_exprs(cfg.key(), done_status)
    groups = [f"k{i}" for i in range(len(R.keys(by)))]
    labels = [f"d_{c}" for c in _LABELS]
    rows = issues.select(*[F.col(c).alias(k) for c, k in zip(R.keys(by), groups)],
                         *[F.col(c).alias(d) for c, d in zip(_LABELS, labels)], *_READ)
    sets = [[*groups, *[f"d_{c}" for c in cols]] for cols in SETS.values()]
    pending = F.count_if(F.col("status").isin(list(C.PENDING_STATUS_PRIORITY_VIEW))).alias("pending")
    name = F.lit(None).cast("string")
    for s in SETS:
        # groups are in every set, so their bits are 0
        name = F.when(F.col("gid") == _set_id(s), F.lit(s)).otherwise(name)
    return (rows.groupingSets(sets, *groups, *labels).agg(F.grouping_id().alias("gid"), *aggs, pending)
            .withColumn("set", name).drop("gid"))


class RollupCube:
    """The written cube of one grouping and its views."""

    def __init__(self, issues: DataFrame, by=None, cfg: C.Config | None = None):
        self.by, self.cfg = R.keys(by), cfg or C.Config()
        spark, frame = issues.sparkSession, cube_frame(issues, by, self.cfg)
        self.path = scratch_path(spark, "cube")
        frame.write.partitionBy("set").parquet(self.path)
        self.table = spark.read.schema(frame.schema).parquet(self.path)

    def _set(self, name: str) -> DataFrame:
        rows = self.table.filter(F.col("set") == name)
        return rows.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(self.by)], *[c for c in rows.columns if c[:1] != "k" or not c[1:].isdigit()])

    def sprints(self) -> DataFrame:
        """The sprint roll-up (``sprint_frame``)."""
        _, proj = _sprint_exprs(self.cfg.key(), "Done")
        return self._set("sprint").select(*self.by, F.col("d_sprint").alias("sprint"), F.col("d_sprint_num").alias("sprint_num"), *proj)

    def assignees(self) -> DataFrame:
        """assignee, assigned, pending, resolved of the non-blank assignees."""
        rows = self._set("assignee").filter(R.is_assigned("d_assignee"))
        return rows.select(*self.by, F.col("d_assignee").alias("assignee"), F.col("bugs").alias("assigned"), "pending",
                           (F.col("bugs") - F.col("pending")).alias("resolved"))

    def developers(self) -> DataFrame:
        """A15 (``assignee_rollup``)."""
        per = R.with_group_total(self.assignees(), "assigned", self.by, "_all")
        return per.select(*self.by, "assignee", "assigned", "resolved", "pending", R.workload_by_total(F.col("assigned")).alias("workload"),
                          pct(F.col("resolved"), F.col("assigned")).alias("efficiency"), pct(F.col("assigned"), F.col("_all")).alias("share"))

    def pending(self) -> DataFrame:
        """assignee, pending (``assignee_pending``)."""
        return self.assignees().select(*self.by, "assignee", "pending")

    def modules(self) -> DataFrame:
        """A13 (``module_breakdown``); in a grouping by module that column is named ``label``."""
        name = "label" if "module" in self.by else "module"
        label = label_or("d_module", C.DEFAULT_MODULE_LABEL).alias(name)
        per = (self._set("module").groupBy(*self.by, label).agg(R.sum_long("bugs").alias("count"), R.sum_long("pending").alias("pending")))
        per = R.with_group_total(per, "count", self.by, "_total")
        return per.withColumn("percentage", pct(F.col("count"), F.col("_total"))).drop("_total")

    def priorities(self, labels=C.PRIORITY_LABELS) -> DataFrame:
        """A12 (``priority_breakdown``): every label, 0 where a group has none."""
        of = lambda c, lab: F.coalesce(F.sum(F.when(F.col("d_priority") == lab, F.col(c))), F.lit(0)).cast("long")
        wide = self._set("priority").groupBy(*self.by).agg(*[of(c, lab).alias(f"{c}{i}") for i, lab in enumerate(labels) for c in ("bugs", "pending")])
        rows = F.array(*[F.struct(F.lit(lab).alias("priority"), F.lit(i).alias("label_order"), F.col(f"bugs{i}").alias("count"),
                                  F.col(f"pending{i}").alias("pending")) for i, lab in enumerate(labels)])
        return wide.select(*self.by, F.inline(rows)).withColumn("resolved", F.col("count") - F.col("pending"))
