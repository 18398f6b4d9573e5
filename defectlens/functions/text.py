"""String helpers: labels, tags, header names, priority canonicalization."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters folded by the accent strip (lower case only,
# the input is lower-cased first) and their plain letters, position by position.
ACCENTED = "áàäâãéèëêíìïîóòöôõúùüûñç"
PLAIN = "aaaaaeeeeiiiiooooouuuunc"

# Keyword -> canonical priority, tested in this order (N10, with
# the lowest-priority words tested first, see decision D3).
PRIORITY_KEYWORDS = [
    ("Trivial", ["masbaja", "lowest", "trivial"]),
    ("Major", ["masalta", "highest", "critical", "critica", "blocker", "major"]),
    ("High", ["alta", "high"]),
    ("Medium", ["media", "medium"]),
    ("Low", ["baja", "low", "minor"]),
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_accents(c) -> Column:
    """Lower-case and fold accents (``NFD`` + drop marks for Latin letters)."""
    return F.translate(F.lower(_c(c)), ACCENTED, PLAIN)


def canonical_priority(c) -> Column:
    """Priority label -> Major/High/Medium/Low/Trivial/Other."""
    key = F.regexp_replace(strip_accents(c), "[^a-z0-9]", "")
    expr = None
    for label, words in PRIORITY_KEYWORDS:
        cond = None
        for w in words:
            cw = key.contains(w)
            cond = cw if cond is None else (cond | cw)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit("Other"))


def label_or(c, default: str) -> Column:
    """``trim(c)`` unless null/blank, else the default label."""
    return F.coalesce(F.nullif(F.trim(_c(c)), F.lit("")), F.lit(default))


def split_tags(*cols) -> Column:
    """Tags from up to N string columns: split on ``[;,|]``, trim, lower, drop blanks.

    Text without a space has nothing to trim; it is split by plain text, with
    no pattern and no function a tag.
    """
    def tags(c) -> Column:
        text = F.coalesce(_c(c), F.lit(""))
        semicolons = F.replace(F.replace(F.lower(text), F.lit(","), F.lit(";")), F.lit("|"), F.lit(";"))
        return F.when(F.contains(text, F.lit(" ")), F.transform(F.split(text, "[;,|]"), lambda x: F.lower(F.trim(x)))) \
            .otherwise(F.split(semicolons, ";"))
    parts = [tags(c) for c in cols]
    arr = parts[0] if len(parts) == 1 else F.concat(*parts)
    return F.array_remove(arr, "")


def initials(c) -> Column:
    """First letter of each word, first two letters."""
    words = F.filter(F.split(F.trim(_c(c)), r"\s+"), lambda x: x != F.lit(""))
    return F.substring(F.array_join(F.transform(words, lambda x: F.left(x, F.lit(1))), ""), 1, 2)


def sprint_number(c) -> Column:
    """First run of 1-4 digits in a sprint label, as int (X7); null if none."""
    return F.expr(f"try_cast(nullif(regexp_extract({_name(c)}, '(\\\\d{{1,4}})', 1), '') as int)") \
        if isinstance(c, str) else \
        F.nullif(F.regexp_extract(_c(c), r"(\d{1,4})", 1), F.lit("")).try_cast("int")


def _name(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


_HEADER_RE = re.compile(r"[^a-z0-9]+")


def normalize_header(name: str) -> str:
    """CSV header cell -> column name: trim, lower, runs of non ``[a-z0-9]`` -> ``_``."""
    return _HEADER_RE.sub("_", (name or "").strip().lower())
