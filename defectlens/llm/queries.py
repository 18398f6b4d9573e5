"""One registered query per operator: (Spark plan over a data folder, DuckDB SQL or None)."""

from __future__ import annotations

from defectlens.llm import op1_secrets, op2_huffman, op3_jaccard, op4_quality, op5_surrogates, op6_urls, op7_decontamination, op8_warc, op9_suffixes
from defectlens.llm import op10_packing as packing, op11_merkle, op12_middle, op13_attention
from defectlens.llm.common import read_table


def op1_secret_scan(spark, sf_dir):
    return op1_secrets.secret_report(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_huffman_ids(spark, sf_dir):
    return op2_huffman.huffman_report(read_table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary("byte_bpe_50k.json"))


def op5_surrogates_pii(spark, sf_dir):
    return op5_surrogates.surrogate_report(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_url_trees(spark, sf_dir):
    return op6_urls.url_report(read_table(spark, sf_dir, "pages", "page_id", "url"))


def op7_decontamination_join(spark, sf_dir):
    return op7_decontamination.contamination_report(
        read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "benchmark", "item_id", "text"))


def op8_warc_segments(spark, sf_dir):
    return op8_warc.warc_report(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op9_suffix_dedup(spark, sf_dir):
    return op9_suffixes.suffix_report(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_packing(spark, sf_dir):
    return packing.packing_report(read_table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary("word_bpe_49k.json"))


def op3_jaccard_join(spark, sf_dir):
    return op3_jaccard.jaccard_report(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_quality_rules(spark, sf_dir):
    return op4_quality.quality_report(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_merkle_manifest(spark, sf_dir):
    return op11_merkle.merkle_report(read_table(spark, sf_dir, "documents", *op11_merkle.FIELDS))


def op12_fill_in_middle(spark, sf_dir):
    return op12_middle.middle_report(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_attention_quality(spark, sf_dir):
    return op13_attention.quality_report(read_table(spark, sf_dir, "documents", "doc_id", "text"),
                                         read_table(spark, sf_dir, "labels", "doc_id", "quality"))


QUERIES = {
    "op1_secret_scan": (op1_secret_scan, op1_secrets.ORACLE),
    "op2_huffman_ids": (op2_huffman_ids, None),
    "op3_jaccard_join": (op3_jaccard_join, None),
    "op4_quality_rules": (op4_quality_rules, op4_quality.ORACLE),
    "op5_surrogates_pii": (op5_surrogates_pii, None),
    "op6_url_trees": (op6_url_trees, None),
    "op7_decontamination_join": (op7_decontamination_join, op7_decontamination.ORACLE),
    "op8_warc_segments": (op8_warc_segments, op8_warc.ORACLE),
    "op9_suffix_dedup": (op9_suffix_dedup, None),
    "op10_packing": (op10_packing, None),
    "op11_merkle_manifest": (op11_merkle_manifest, op11_merkle.ORACLE),
    "op12_fill_in_middle": (op12_fill_in_middle, op12_middle.ORACLE),
    "op13_attention_quality": (op13_attention_quality, None),
}
