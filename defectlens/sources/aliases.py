"""Alias resolution (N1-N4): canonical field <- first truthy of its aliases.

Fixed values: the alias chains the dashboard accepts, in its order.  The
sprint chain for resolved issues omits ``critical`` (decision D6).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from defectlens.functions import first_truthy, first_truthy_str

SPRINT_ALIASES = {
    "sprint": ["sprint", "sprint_num", "sprint_numero", "nombre_sprint"],
    "bugs": ["total", "bugs", "bugs_encontrados", "defectos_encontrados"],
    "bugs_resolved": ["bugsResolved", "bugs_resueltos", "defectos_cerrados"],
    "bugs_pending": ["bugsPending", "bugs_pendientes", "defectos_pendientes"],
    "test_cases": ["testCases", "casosEjecutados", "test_cases", "casos_ejecutados", "test_executed", "total"],
    "test_planned": ["testPlanned", "casosPlaneados", "test_planned", "casos_planeados", "testCasesPlanned",
                     "test_cases_planned"],
    "change": ["change", "cambio"],
    "version": ["version", "version_entrega", "version_numero"],
    "environment": ["environment", "ambiente"],
    "start_date": ["startDate", "start_date", "fecha_inicio"],
    "velocity": ["velocity"],
    "planned_velocity": ["plannedVelocity"],
    "critical_total": ["criticalBugsTotal", "critical"],
    "critical_pending": ["criticalBugsPending", "critical_pending"],
}
SPRINT_TEXT = {"sprint", "version", "environment", "start_date"}

DEVELOPER_ALIASES = {
    "name": ["developer_name", "name", "asignado_a", "nombre_desarrollador"],
    "assigned": ["total_bugs", "assigned", "bugs_asignados", "defectos_asignados"],
    "resolved": ["resolved", "code_review", "bugs_resueltos", "defectos_resueltos"],
    "pending": ["pending", "tareas_por_hacer", "bugs_pendientes", "defectos_pendientes"],
    "workload": ["workload_level", "workload", "carga_trabajo", "nivel_carga"],
    "efficiency": ["efficiency", "eficiencia"],
    "avg_resolution_time": ["avgResolutionTime", "avg_resolution_time", "tiempo_promedio_resolucion"],
}
DEVELOPER_TEXT = {"name", "workload"}

MODULE_ALIASES = {
    "total": ["total", "count", "bugs"],
    "pending": ["pending", "pendientes"],
    "resolved": ["resolved", "resueltos"],
    "percentage": ["percentage", "porcentaje"],
}

ISSUE_ALIASES = {
    "sprint": ["sprint"],
    "status": ["status", "estado"],
    "priority": ["priority", "prioridad"],
    "assignee": ["assignee", "asignado_a", "desarrollador"],
    "issue_type": ["issue_type", "tipo_incidencia"],
    "summary": ["summary", "resumen"],
    "module": ["module", "modulo", "m_dulo"],
    "category": ["category", "categoria", "categor_a"],
    "environment": ["environment", "ambiente"],
    "strategy": ["strategy", "estrategia"],
    "fix_version": ["fixversion", "fix_version", "version", "versi_n"],
    "tags": ["tags", "tag"],
}


def resolve(present: set[str], aliases: dict[str, list[str]], text: set[str], prefix: str = "") -> list[Column]:
    """One column per canonical field: first truthy among the aliases that
    exist (``prefix`` addresses struct fields, e.g. ``s.``)."""
    out = []
    for name, chain in aliases.items():
        cols = [F.col(prefix + a) for a in chain if a in present]
        if name in text:
            expr = first_truthy_str(*[c.cast("string") for c in cols]) if cols else F.lit("")
        else:
            expr = first_truthy(*[c.cast("double") for c in cols]) if cols else F.lit(0)
            expr = expr.cast("long")
        out.append(expr.alias(name))
    return out
