"""The document behind the golden values (fixed values) and the files the tests read."""

from __future__ import annotations

import json
import os
import tempfile

# Bugs, resolved bugs and velocity of the sprints 0 to 20.
SPRINTS = [
    (39, 16, 33), (46, 9, 39), (65, 17, 55), (39, 9, 33), (53, 14, 45), (53, 16, 45), (42, 12, 36), (60, 17, 51),
    (44, 6, 37), (46, 0, 39), (53, 9, 45), (47, 12, 40), (67, 17, 57), (65, 11, 55), (48, 12, 41), (48, 10, 41),
    (60, 16, 51), (40, 15, 34), (36, 9, 31), (25, 10, 21), (24, 2, 20)]
# Assigned and resolved issues of the developers.
DEVELOPERS = [
    (66, 11), (58, 9), (57, 5), (57, 9), (56, 8), (56, 16), (54, 10), (52, 10), (51, 11), (49, 5), (48, 9), (47, 8),
    (47, 8), (45, 9), (45, 6), (45, 8), (44, 2), (43, 10), (40, 6), (40, 5)]
# Count and percentage by priority and by module.
PRIORITIES = {'Alta': (239, 24), 'Baja': (286, 29), 'Media': (316, 32), 'M�s Alta': (159, 16)}
MODULES = {'Integración': (250, 25), 'Funcional': (400, 40), 'UI/UX': (200, 20), 'Base de Datos': (150, 15)}


def document() -> dict:
    part = lambda table: {k: {"count": n, "percentage": p, "pending": 0} for k, (n, p) in table.items()}
    closed = sum(r for _, r in DEVELOPERS)
    total = sum(b for b, _, _ in SPRINTS)
    return {
        "metadata": {"source": "test", "version": "1"},
        "summary": {"totalBugs": total, "bugsClosed": closed, "bugsPending": total - closed, "testCasesTotal": total,
                    "testCasesExecuted": total, "testCasesPassed": closed, "testCasesFailed": total - closed},
        "bugsByPriority": part(PRIORITIES), "bugsByModule": part(MODULES),
        "developerData": [{"name": f"Developer {k}", "assigned": a, "resolved": r, "pending": a - r, "totalBugs": a}
                          for k, (a, r) in enumerate(DEVELOPERS, 1)],
        "sprintData": [{"sprint": f"Sprint {k}", "bugs": b, "bugsResolved": r, "bugsPending": b - r, "testCases": b,
                        "velocity": v, "plannedVelocity": b, "change": 0} for k, (b, r, v) in enumerate(SPRINTS)],
        "bugsByCategory": {}, "qualityMetrics": {"testAutomation": 45, "cycleTime": 5}}


def write_files() -> tuple[str, str, str]:
    """A folder, its document, and a document that breaks off."""
    folder, broken = tempfile.mkdtemp(prefix="golden-"), tempfile.mkdtemp(prefix="golden-")
    good, bad = os.path.join(folder, "document.json"), os.path.join(broken, "broken.json")
    text = json.dumps(document(), ensure_ascii=False)
    for path, content in ((good, text), (bad, text[:len(text) // 2])):
        with open(path, "w", encoding="utf-8") as f:
            f.write(content)
    return folder, good, bad
