"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_extract, lattice_lm, line_dedup, minhash, packing, pii, quality_rules, suffix_dedup, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_suffix_dedup": lambda s, d: suffix_dedup.op1(table(s, d, "documents")),
    "op2_line_dedup": lambda s, d: line_dedup.op2(table(s, d, "documents")),
    "op2_every_unit_dedup": lambda s, d: line_dedup.op2(table(s, d, "documents"), least_run=0),
    "op3_quality_rules": lambda s, d: quality_rules.op3(table(s, d, "documents"), table(s, d, "labels")),
    "op4_subword_lattice": lambda s, d: lattice_lm.op4(table(s, d, "documents")),
    "op5_minhash_near_dedup": lambda s, d: minhash.op5(table(s, d, "documents")),
    "op6_benchmark_decontamination": lambda s, d: decontaminate.op6(table(s, d, "documents"), table(s, d, "benchmark")),
    "op7_toxicity": lambda s, d: toxicity.op7(table(s, d, "documents"), table(s, d, "labels")),
    "op8_pii": lambda s, d: pii.op8(table(s, d, "documents")),
    "op9_html_extraction": lambda s, d: html_extract.op9(table(s, d, "pages")),
    "op10_best_fit_packing": lambda s, d: packing.op10(table(s, d, "documents")),
}

SQL: dict[str, str] = {
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op2_every_unit_dedup": line_dedup.OP2_EVERY_SQL,
    "op6_benchmark_decontamination": decontaminate.OP6_SQL,
}
