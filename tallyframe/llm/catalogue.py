"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import ann_bits, bpe_prefix, filter_audit, jaccard_join, line_dedup, media, packing, quality_fm, source_divergence, token_spans, toxicity, url_trees, warc_index


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_media_columns": media.op1_media_columns,
        "op2_token_counts": token_spans.op2_token_counts,
        "op3_jaccard_join": jaccard_join.op3_jaccard_join,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_ann_bits": ann_bits.op5_ann_bits,
        "op6_bpe_prefix": bpe_prefix.op6_bpe_prefix,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_packing": packing.op8_packing,
        "op9_url_trees": url_trees.op9_url_trees,
        "op10_warc_index": warc_index.op10_warc_index,
        "op11_source_divergence": source_divergence.op11_source_divergence,
        "op12_quality_fm": quality_fm.op12_quality_fm,
        "op13_filter_audit": filter_audit.op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_line_dedup": line_dedup.OP7_SQL,
        "op10_warc_index": warc_index.OP10_SQL,
        "op11_source_divergence": source_divergence.OP11_SQL,
        "op13_filter_audit": filter_audit.OP13_SQL,
    }
