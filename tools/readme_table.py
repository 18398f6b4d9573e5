"""Regenerate the registered-query table in README.md from the registry."""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from defectlens.plans.catalog import load_all  # noqa: E402

reg = load_all()
rows = "\n".join(f"| `{n}` | {s.operators} |" for n, s in reg.items())
path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "README.md")
text = open(path, encoding="utf-8").read()
head = "| query | SURVEY section 2 operators |\n| --- | --- |\n"
start = text.index(head) + len(head)
end = text.index("\n\n", start)
text = text[:start] + rows + text[end:]
n, k = len(reg), sum(1 for s in reg.values() if s.sql)
text = re.sub(r"`queries\(\)` registers \d+ plans; all \d+ have", f"`queries()` registers {n} plans; all {k} have", text)
text = re.sub(r"match it \(row count", "match it (row count", text)
open(path, "w", encoding="utf-8").write(text)
print(n, k)
