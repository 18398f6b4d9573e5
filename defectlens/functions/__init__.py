"""Column builders shared by every operator (all JVM-side expressions)."""

from defectlens.functions.jsnum import (  # noqa: F401
    clamp, first_truthy, first_truthy_str, fixed1, fixed2, fixed6, js_round, pct,
    safe_div, truthy_or,
)
from defectlens.functions.text import (  # noqa: F401
    canonical_priority, initials, label_or, normalize_header, split_tags, strip_accents,
    sprint_number,
)
