"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fjordbook.llm import ann, archives, fingerprints, lines, mining, mixing, neardup, packing, quality, ranking, substrings, suffixdedup, training_order

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_archives": archives.op1,
    "op2_substrings": substrings.op2,
    "op3_training_order": training_order.op3,
    "op4_mixing": mixing.op4,
    "op5_neardup": neardup.op5,
    "op6_quality": quality.op6,
    "op7_neighbours": ann.op7,
    "op8_packing": packing.op8,
    "op9_lines": lines.op9,
    "op10_fingerprints": fingerprints.op10,
    "op11_ranking": ranking.op11,
    "op12_suffixes": suffixdedup.op12,
    "op13_negatives": mining.op13,
}
ORACLES: dict[str, str] = {"op9_lines": lines.ORACLE, "op11_ranking": ranking.ORACLE, "op13_negatives": mining.ORACLE}
