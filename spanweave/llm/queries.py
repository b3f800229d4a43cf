"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanweave.llm import sql
from spanweave.llm.jaccard import op7_ngram_jaccard_join
from spanweave.llm.packing import op6_best_fit_packing
from spanweave.llm.perspectives import OP5_SQL, op5_perspective_rotation
from spanweave.llm.pii import op2_pii_spans
from spanweave.llm.quality import op1_quality_rules
from spanweave.llm.secrets import op3_secret_scan
from spanweave.llm.suffixes import op4_suffix_dedup
from spanweave.llm.urls import op10_url_filter
from spanweave.llm.warc import op9_warc_segments
from spanweave.llm.winnow import op8_benchmark_decontamination

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_pii_spans": op2_pii_spans,
    "op3_secret_scan": op3_secret_scan,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_perspective_rotation": op5_perspective_rotation,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_warc_segments": op9_warc_segments,
    "op10_url_filter": op10_url_filter,
}
ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": sql.OP1,
    "op5_perspective_rotation": OP5_SQL,
    "op7_ngram_jaccard_join": sql.OP7,
    "op8_benchmark_decontamination": sql.OP8,
    "op9_warc_segments": sql.OP9,
}
