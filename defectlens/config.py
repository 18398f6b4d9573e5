"""Configuration: weights, thresholds and vocabularies.

Values enter plans as literals (driver-side config, deep-merged once), so a
config change never costs a data pass.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass, field
from typing import Any

# ---------------------------------------------------------------------------
# Fixed values that must equal the dashboard's for equal results.
# ---------------------------------------------------------------------------

# Quality-index weights.
DEFAULT_WEIGHTS = {
    "resolutionRate": 0.3,
    "testCoverage": 0.25,
    "bugDensity": 0.2,
    "criticalBugs": 0.25,
}

# Alert / recommendation thresholds.
DEFAULT_THRESHOLDS = {
    "criticalBugsAlert": 20,
    "maxBugsDeveloper": 15,
    "criticalModulePercentage": 60,
    "minTestCoverage": 80,
    "maxBugTrendIncrease": 20,
    "maxDefectDensity": 0.1,
    "minResolutionEfficiency": 70,
    "maxCriticalBugsRatio": 20,
}

# Priority groups used by the KPI record.
DEFAULT_PRIORITIES = {
    "critical": ["Más alta", "Alta"],
    "high": ["Media"],
    "low": ["Baja", "Más baja"],
}

# Per-module weight and critical threshold (configured, see R21).
DEFAULT_MODULES = {
    "POS": {"weight": 0.4, "criticalThreshold": 50},
    "Inventory": {"weight": 0.3, "criticalThreshold": 40},
    "Reports": {"weight": 0.2, "criticalThreshold": 30},
    "Admin": {"weight": 0.1, "criticalThreshold": 20},
}

# Labels counted as critical by the robust critical count (K6).
CRITICAL_LABELS_ALL = ["Más alta", "Alta", "Critical", "High", "Crítica"]

# Priority labels of the roll-up document, in display order.
PRIORITY_LABELS = ["Más alta", "Alta", "Media", "Baja", "Más baja"]

# Status vocabularies.
PENDING_STATUS_SPRINT_VIEW = ["To Do"]                     # A1
PENDING_STATUS_PRIORITY_VIEW = ["To Do", "In Development"]  # A2
CANCELED_STATUS = ["Canceled"]                             # A1
PENDING_STATUS_TEAM = ["Tareas por hacer"]                 # A7
CLOSED_STATUS_SQL = ["Done", "Resolved", "Closed"]         # F15, case-sensitive
CLOSED_STATUS_EXACT = ["cerrado", "closed", "done", "resuelto", "resolved"]  # F13, lower-cased
CLOSED_STATUS_KEYWORDS = ["resolved", "closed", "resuelto", "cerrado"]       # F14, contains
SPRINT_VIEW_CRITICAL = ["Major"]                           # A1 / A5
REOPENED_STATUS = ["Reopened"]                             # K33

# Label defaults for missing values.
DEFAULT_MODULE_LABEL = "Sin módulo"
DEFAULT_CATEGORY_LABEL = "Sin categoría"
DEFAULT_ASSIGNEE_LABEL = "Sin asignar"

# Cost model of the early-detection estimate (K20), USD.
COST_BUG_PRODUCTION = 5000
COST_BUG_DEVELOPMENT = 500

# Sprint length in days.
SPRINT_DAYS = 14

# Maturity level names (K19), score 1..5.
MATURITY_LEVELS = {1: "Inicial", 2: "Repetible", 3: "Definido", 4: "Gestionado", 5: "Optimizado"}

# Alert cooldowns in seconds.
ALERT_COOLDOWN = {"critical": 3600, "warning": 7200}

# Dashboard refresh interval in milliseconds.
REFRESH_INTERVAL_MS = 300000


def merge_deep(base: dict, override: dict) -> dict:
    """Key-by-key merge of nested dicts; lists and scalars replace."""
    out = copy.deepcopy(base)
    for k, v in (override or {}).items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = merge_deep(out[k], v)
        else:
            out[k] = copy.deepcopy(v)
    return out


@dataclass
class Config:
    weights: dict = field(default_factory=lambda: dict(DEFAULT_WEIGHTS))
    thresholds: dict = field(default_factory=lambda: dict(DEFAULT_THRESHOLDS))
    priorities: dict = field(default_factory=lambda: copy.deepcopy(DEFAULT_PRIORITIES))
    modules: dict = field(default_factory=lambda: copy.deepcopy(DEFAULT_MODULES))
    # Predictions count as a maturity factor only when switched on.
    count_predictions_in_maturity: bool = False
    # Test automation percentage when the data carries none.
    test_automation: float = 0.0

    @classmethod
    def from_dict(cls, override: dict[str, Any] | None) -> "Config":
        base = {
            "weights": DEFAULT_WEIGHTS,
            "thresholds": DEFAULT_THRESHOLDS,
            "priorities": DEFAULT_PRIORITIES,
            "modules": DEFAULT_MODULES,
        }
        merged = merge_deep(base, override or {})
        extra = {k: v for k, v in (override or {}).items() if k not in base}
        return cls(weights=merged["weights"], thresholds=merged["thresholds"],
                   priorities=merged["priorities"], modules=merged["modules"], **extra)

    def key(self) -> str:
        """Stable text form (memoization key for expression builders)."""
        import json
        from dataclasses import asdict
        return json.dumps(asdict(self), sort_keys=True, ensure_ascii=False)

    @classmethod
    def from_key(cls, key: str) -> "Config":
        import json
        return cls(**json.loads(key))

    @property
    def critical_labels(self) -> list[str]:
        return list(self.priorities.get("critical", []))
