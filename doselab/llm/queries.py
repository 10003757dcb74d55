"""The subpackage's queries, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from doselab.llm.alignment import op12_cross_tokenizer_alignment
from doselab.llm.byte_bpe import op13_byte_bpe
from doselab.llm.jaccard_join import op2_jaccard_join
from doselab.llm.license_scan import op9_license_scan
from doselab.llm import line_dedup, topk_search, warc
from doselab.llm.line_dedup import op10_line_dedup
from doselab.llm.mixing import op3_source_mixing
from doselab.llm.packing import op1_best_fit_packing
from doselab.llm.quality_classifier import op8_quality_classifier
from doselab.llm.quality_rules import op6_quality_rules
from doselab.llm.topk_search import op7_topk_search
from doselab.llm.toxicity import op4_toxicity
from doselab.llm.warc import op5_warc
from doselab.llm.whitening import op11_whitening

_QUERIES = [op1_best_fit_packing, op2_jaccard_join, op3_source_mixing, op4_toxicity, op5_warc, op6_quality_rules, op7_topk_search, op8_quality_classifier, op9_license_scan, op10_line_dedup, op11_whitening, op12_cross_tokenizer_alignment, op13_byte_bpe]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": warc.ORACLE, "op7_topk_search": topk_search.ORACLE, "op10_line_dedup": line_dedup.ORACLE}
