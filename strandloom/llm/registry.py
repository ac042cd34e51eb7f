"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from strandloom.llm import decontaminate, filter_audit, language, mixing, neighbours, packing, pii, simhash, substring, token_counts, url_filter, wavelet, whitening

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_packing": packing.op2_packing,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_pii": pii.op4_pii,
    "op5_language_id": language.op5_language_id,
    "op6_neighbours": neighbours.op6_neighbours,
    "op7_token_files": wavelet.op7_token_files,
    "op9_simhash": simhash.op9_simhash,
    "op8_substring_dedup": substring.op8_substring_dedup,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_whitening": whitening.op11_whitening,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_mixing": mixing.op13_mixing,
    "pipeline": corpus_pipeline.run,
}
SQL = {"op3_decontamination": decontaminate.SQL, "op8_substring_dedup": substring.SQL, "op10_url_filter": url_filter.SQL, "op12_filter_audit": filter_audit.SQL, "op13_mixing": mixing.SQL}
