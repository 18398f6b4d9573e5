"""defectlens: issue-quality analytics as Spark DataFrame plans.

Every measure is a DataFrame expression grouped by an arbitrary list of keys
(``by=[...]``), so the single-project dashboard case is ``by=[]`` and the
many-project case is the same plan with more grouping keys.
"""

from defectlens.config import Config

__all__ = ["Config"]
