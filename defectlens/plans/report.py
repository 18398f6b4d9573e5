"""Whole-report entry points (E1-E5): each returns a dict of lazy
DataFrames that share one roll-up cube, so a report costs one pass over
the issue table plus small passes over the cube's sets.

``cache_rollups=True`` persists the sprint roll-up when several outputs of a
report are materialized together (as the dashboard does); ``release()`` ends that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defectlens import config as C
from defectlens.operators import filters as FL
from defectlens.operators import kpis as K
from defectlens.operators import rollups as R
from defectlens.operators import rules as RU
from defectlens.operators import topk as TK
from defectlens.operators import trends as TR
from defectlens.operators import verify as V
from defectlens.operators.cube import RollupCube
from defectlens.operators.sprints import sprint_frame
from defectlens.sources import documents as D


class QualityReport:
    """``process(raw, config)`` as lazy DataFrames grouped by ``by``."""

    def __init__(self, issues: DataFrame, by=None, cfg: C.Config | dict | None = None,
                 cache_rollups: bool = False):
        self.issues = issues
        self.by = list(by or [])
        self.cfg = cfg if isinstance(cfg, C.Config) else C.Config.from_dict(cfg)
        self.cube = RollupCube(issues, self.by, self.cfg)
        sp = self.cube.sprints()
        self.sprints = sp.persist() if cache_rollups else sp

    def release(self) -> None:
        """Drop the persisted roll-up."""
        self.sprints.unpersist()

    def kpis(self) -> DataFrame:
        return K.kpis(self.sprints, self.by, self.cfg)

    def trends(self) -> DataFrame:
        return TR.sprint_trends(self.sprints, self.by)

    def velocity(self) -> DataFrame:
        return TR.velocity_change(self.sprints, self.by)

    def developers(self) -> DataFrame:
        return self.cube.developers()

    def modules(self) -> DataFrame:
        return self.cube.modules()

    def priorities(self) -> DataFrame:
        return self.cube.priorities()

    def alerts(self) -> DataFrame:
        devs = self.cube.pending()
        if "module" in self.by:
            # R3 ranks modules inside a group; a module group has no sub-modules.
            mods = self.kpis().select(*self.by, F.lit(0).cast("long").alias("percentage")).filter(F.lit(False))
        else:
            mods = self.modules().select(*self.by, "module", "percentage")
        return RU.alerts(self.kpis(), devs, mods, self.by, self.cfg)

    def recommendations(self) -> DataFrame:
        th = self.cfg.thresholds["maxBugsDeveloper"]
        devs = self.cube.pending()
        ov = RU.first_over(devs.filter(F.col("pending") > th), self.by, [F.desc("pending"), F.asc("assignee")]) \
            .select(*self.by, F.col("assignee").alias("overloaded_assignee"))
        return RU.recommendations(self.kpis(), ov, self.by, self.cfg)

    def predictions(self) -> DataFrame:
        return K.predictions(self.kpis(), self.by)

    def rule_recommendations(self, rules=None, user_rules: DataFrame | None = None) -> DataFrame:
        """The rule table evaluated on this report's metrics.
        ``user_rules`` (rule_id, metric, condition, text, priority; old or new
        metric names) replace the defaults of the metrics they mention.  The
        merged table may be of any length: its conditions become intervals and
        are joined (``rule_intervals``), nothing of it comes to the driver."""
        from defectlens.operators import rule_intervals as RI
        from defectlens.operators.rule_table import DEFAULT_RULES
        table = list(rules or DEFAULT_RULES)
        cyc = K.cycle_time(self.sprints, self.priorities(), self.by) \
            .select(*self.by, "cycle_time", "critical_days")
        metrics = RU.metric_fields(self.kpis(), cyc, self.by)
        if user_rules is None:
            return RU.evaluate_rules(metrics, table, self.by)
        effective = RU.effective_rules(RU.rules_frame(self.issues.sparkSession, table), user_rules)
        return RI.evaluate_rule_table(metrics, effective, self.by)

    def maturity(self) -> DataFrame:
        return K.maturity(self.kpis(), self.by)

    def roi(self) -> DataFrame:
        return K.roi_text(self.kpis(), self.by)

    def all(self) -> dict[str, DataFrame]:
        return {"kpis": self.kpis(), "trends": self.trends(), "velocity": self.velocity(),
                "alerts": self.alerts(), "recommendations": self.recommendations(),
                "predictions": self.predictions(), "maturity": self.maturity(), "roi": self.roi(),
                "rule_recommendations": self.rule_recommendations(), "developers": self.developers(),
                "modules": self.modules(), "priorities": self.priorities()}

    def all_rows(self) -> DataFrame:
        """E1 as one table (by, part, key, value): the figures of every part under names of their own."""
        c = F.col
        row = lambda part, key, value: F.struct(F.lit(part).alias("part"), key.alias("key"), value.cast("double").alias("value"))
        kpis, bags = self.kpis(), []
        figures = [f for f, t in kpis.dtypes if t in ("bigint", "double") and f not in self.by]
        # a generator keeps one reading of the KPI record for all its figures
        bags.append(kpis.select(*self.by, F.inline(F.array(*[row("kpi", F.lit(f), c(f)) for f in figures]))))
        module = "label" if "module" in self.by else "module"
        for part, frame, key, value in (
                ("sprint", self.sprints, c("sprint"), c("bugs")), ("developer", self.developers(), c("assignee"), c("pending")),
                ("module", self.modules(), c(module), c("percentage")), ("priority", self.priorities(), c("priority"), c("pending")),
                ("alert", self.alerts(), c("alert_id"), c("rank")), ("recommendation", self.recommendations(), c("rec_id"), c("rank")),
                ("prediction", self.predictions(), c("metric"), c("confidence"))):
            bags.append(frame.select(*self.by, F.inline(F.array(row(part, key, value)))))
        return reduce(DataFrame.unionByName, bags)


def filtered_issues(issues: DataFrame, sprints_df: DataFrame | None = None, include_bugs: bool = False,
                    **filters) -> dict[str, DataFrame]:
    """List filters (F1-F4) -> filtered summary (A18), the sprints that
    match or have issues left (J2), and optionally the issues themselves."""
    f = issues.filter(FL.issue_filter(columns=issues.columns, **filters))
    summary = f.agg(F.count(F.lit(1)).alias("total_bugs"), F.count_if(FL.closed_exact()).alias("bugs_closed"))
    sp = sprints_df if sprints_df is not None else sprint_frame(issues)
    terms = FL.parse_list(filters.get("sprints"))
    # Without a sprint filter every sprint is kept (the dashboard's "|| true").
    out = {"summary": summary, "sprints": K.sprints_matching(sp, f, terms) if terms else sp}
    if include_bugs:
        out["bugs"] = f
    return out


def team_analysis(issues: DataFrame, by=None) -> dict[str, DataFrame]:
    """The six team results; the bug-only inputs share one filter."""
    return {"summary": R.team_summary(issues, by), "top_developers": TK.top_assignees(issues, 5, by),
            "developer_summaries": R.assignee_summary(issues, by), "assignment": R.assignment_split(issues, by),
            "statuses": TK.distinct_values(issues, "status"),
            "issue_types": TK.distinct_values(issues, "issue_type")}


def rollup_document(issues: DataFrame, by=None, as_json: bool = False) -> DataFrame:
    """The roll-up document (A12-A16) as one nested row per group."""
    by = list(by or [])
    sp = sprint_frame(issues, by)
    docs = D.issues_to_documents(sp, by, R.priority_breakdown(issues, by))
    share = lambda d: F.struct("count", "percentage")
    modules = R.share_breakdown(issues, "module", C.DEFAULT_MODULE_LABEL, by)
    categories = R.share_breakdown(issues, "category", C.DEFAULT_CATEGORY_LABEL, by, with_pending=False)
    # maps and lists bounded by the modules, categories and developers of a group
    for name, frame, value in (("bugsByModule", modules, F.struct("count", "percentage", "pending")),
                               ("bugsByCategory", categories, share(categories))):
        docs = D.with_section(docs, frame.groupBy(*by).agg(
            F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("key"), value.alias("v"))))).alias(name)), by)
    developers = TK.developers_by_pending(issues, by).groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct(F.col("assignee").alias("name"), F.col("pending")))).alias("developerData"))
    docs = D.with_section(docs, developers, by)
    if as_json:
        return docs.select(*by, F.to_json(F.struct(*[c for c in docs.columns if c not in by])).alias("document"))
    return docs


def verify(source_a: DataFrame, source_b: DataFrame, critical_a, pending_a, critical_b, pending_b) -> dict:
    """E5: per-sprint reconciliation (J1, V2) and its summary (V1, V3, V4)."""
    rec = V.reconcile_sprints(V.sprint_counts(source_a, critical_a, pending_a),
                              V.sprint_counts(source_b, critical_b, pending_b))
    return {"sprints": rec, "summary": V.reconciliation_summary(rec)}


def process_documents(docs: DataFrame, cfg: C.Config | None = None) -> dict[str, DataFrame]:
    """V6: validate -> quarantine -> sanitize -> KPIs per document.  Invalid
    or corrupt documents go to ``quarantine`` with their errors instead of
    being silently replaced by an empty record."""
    cfg = cfg or C.Config()
    good, corrupt = D.split_corrupt(docs)
    errs = V.validate_document(good)
    valid = good.join(errs.filter("is_valid").select("doc_path"), "doc_path", "left_semi")
    invalid = errs.filter(~F.col("is_valid")).select("doc_path", "errors")
    sprints = V.sanitize_sprints(D.sprint_rows(valid))
    sprints = sprints.withColumns({"critical_pending": F.lit(0), "res_days_sum": F.lit(0), "res_days_n": F.lit(0)})
    summ = D.summary_row(valid, cfg.critical_labels, C.CRITICAL_LABELS_ALL)
    quarantine = corrupt.select("doc_path", F.array(F.lit("corrupt JSON")).alias("errors")).unionByName(invalid)
    return {"kpis": K.kpis(sprints, ["doc_path"], cfg, summary=summ), "sprints": sprints, "documents": valid, "quarantine": quarantine}
