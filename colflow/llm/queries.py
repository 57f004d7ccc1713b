"""Queries over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from colflow.llm import line_runs, quality
from colflow.llm.alignment import op11_token_alignment
from colflow.llm.bpe import op2_bpe
from colflow.llm.conversations import op12_conversation_repair
from colflow.llm.decontaminate import op6_decontamination
from colflow.llm.jaccard import op7_jaccard_join
from colflow.llm.lattice import op5_lm_score
from colflow.llm.line_runs import op3_line_dedup
from colflow.llm.notices import op8_license_scan
from colflow.llm.quality import op1_quality
from colflow.llm.recompress import op4_substring_dedup
from colflow.llm.secrets import op13_secret_scan
from colflow.llm.sharding import op9_sharding
from colflow.llm.warc_zip import op10_warc

QUERIES = {
    "op1_quality": op1_quality,
    "op2_bpe": op2_bpe,
    "op3_line_dedup": op3_line_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_lm_score": op5_lm_score,
    "op6_decontamination": op6_decontamination,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_license_scan": op8_license_scan,
    "op9_sharding": op9_sharding,
    "op10_warc": op10_warc,
    "op11_token_alignment": op11_token_alignment,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_secret_scan": op13_secret_scan,
}

ORACLES: dict[str, str] = {"op1_quality": quality.oracle_sql(), "op3_line_dedup": line_runs.oracle_sql()}
