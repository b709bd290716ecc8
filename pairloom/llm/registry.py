"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from . import decontaminate, exact_dedup, hash_forest, language_id, near_dedup, packing, peak_sweep, periodic_runs, secret_scan, substring_dedup, token_files, url_filter, warc_fixity

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_secret_scan": secret_scan.op2_secret_scan,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_warc_fixity": warc_fixity.op4_warc_fixity,
    "op5_packing": packing.op5_packing,
    "op6_language_id": language_id.op6_language_id,
    "op7_token_files": token_files.op7_token_files,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_near_dedup": near_dedup.op10_near_dedup,
    "op11_peak_sweep": peak_sweep.op11_peak_sweep,
    "op12_hash_forest": hash_forest.op12_hash_forest,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op9_substring_dedup": substring_dedup.OP9_SQL,
    "op10_near_dedup": near_dedup.OP10_SQL,
    "op11_peak_sweep": peak_sweep.OP11_SQL,
    "op13_periodic_runs": periodic_runs.OP13_SQL,
}
