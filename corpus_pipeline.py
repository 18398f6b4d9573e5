"""Corpus pipeline: the stages over ``documents``, each written as Parquet and read again.

Each stage function takes (spark, docs, sf_dir); all but the last return the
columns of ``documents``, so that a stage's decisions are all that changes.
"""

from __future__ import annotations

from defectlens.llm import op1_secrets, op3_jaccard, op4_quality, op7_decontamination, op10_packing
from defectlens.llm.common import read_table, staged
from defectlens.llm.queries import vocabulary


def quality_rules(spark, docs, sf_dir):
    """Documents that the line-first rules keep, failing lines removed."""
    return op4_quality.keep_clean(docs)


def jaccard_join(spark, docs, sf_dir):
    """One document of each group of near copies, the one with the smallest id."""
    return op3_jaccard.keep_one(docs)


def decontamination(spark, docs, sf_dir):
    """Documents without a window of the benchmark."""
    return op7_decontamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))


def secret_scans(spark, docs, sf_dir):
    """All documents, found secrets masked."""
    return op1_secrets.redact(docs)


def packing(spark, docs, sf_dir):
    """Pieces of the documents with their place in the sequences."""
    return op10_packing.packing_report(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("packing", packing),
]

#: The join's MinHash pruning and the tokenizer have no SQL form; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage over the whole table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
