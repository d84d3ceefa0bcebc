"""One query for every operator, over its whole table with production parameters."""

from __future__ import annotations

from lexspan.llm.bpe import op12_byte_bpe
from lexspan.llm.codes import OP13_SQL, op13_vector_codes
from lexspan.llm.conversations import op11_conversation_repair
from lexspan.llm.ctw import op3_lm_scoring
from lexspan.llm.decontam import op7_benchmark_leaks
from lexspan.llm.langid import op6_language_id
from lexspan.llm.neardup import op4_near_duplicates
from lexspan.llm.packing import op10_packing
from lexspan.llm.quality import op2_quality_rules
from lexspan.llm.rollups import OP5_SQL, op5_token_counts
from lexspan.llm.secrets import op1_secret_scan
from lexspan.llm.sql import conversation_repair_sql, secret_scan_sql, url_filter_sql
from lexspan.llm.toxicity import op8_toxicity
from lexspan.llm.urls import op9_url_filter

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_quality_rules": op2_quality_rules,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_token_counts": op5_token_counts,
    "op6_language_id": op6_language_id,
    "op7_benchmark_leaks": op7_benchmark_leaks,
    "op8_toxicity": op8_toxicity,
    "op9_url_filter": op9_url_filter,
    "op10_packing": op10_packing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_vector_codes": op13_vector_codes,
}

SQL: dict[str, str] = {
    "op1_secret_scan": secret_scan_sql(),
    "op5_token_counts": OP5_SQL,
    "op9_url_filter": url_filter_sql(),
    "op11_conversation_repair": conversation_repair_sql(),
    "op13_vector_codes": OP13_SQL,
}
