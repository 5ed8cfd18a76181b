"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from bazaarlake.llm.exact_dedup import EXACT_DEDUP_SQL, exact_dedup
from bazaarlake.llm.fingerprints import document_fingerprints
from bazaarlake.llm.lexical_search import LEXICAL_SEARCH_SQL, ranked_search
from bazaarlake.llm.line_dedup import LINE_DEDUP_SQL, line_dedup
from bazaarlake.llm.minhash_dedup import MINHASH_DEDUP_SQL, minhash_dedup
from bazaarlake.llm.packing import best_fit_packing
from bazaarlake.llm.periodic_runs import PERIODIC_RUNS_SQL, periodic_run_detection
from bazaarlake.llm.quality_rules import quality_rules
from bazaarlake.llm.secret_scan import SECRET_SCAN_SQL, secret_scan
from bazaarlake.llm.sentencepiece_codec import sentencepiece_codec
from bazaarlake.llm.suffix_dedup import SUFFIX_DEDUP_SQL, suffix_dedup
from bazaarlake.llm.token_counts import token_counts
from bazaarlake.llm.toxicity import toxicity

QUERIES = {
    "op1_minhash_dedup": minhash_dedup,
    "op2_token_counts": token_counts,
    "op3_suffix_dedup": suffix_dedup,
    "op4_best_fit_packing": best_fit_packing,
    "op5_sentencepiece_codec": sentencepiece_codec,
    "op6_toxicity": toxicity,
    "op7_exact_dedup": exact_dedup,
    "op8_line_dedup": line_dedup,
    "op9_secret_scan": secret_scan,
    "op10_document_fingerprints": document_fingerprints,
    "op11_periodic_runs": periodic_run_detection,
    "op12_ranked_search": ranked_search,
    "op13_quality_rules": quality_rules,
}

ORACLES = {
    "op1_minhash_dedup": MINHASH_DEDUP_SQL,
    "op3_suffix_dedup": SUFFIX_DEDUP_SQL,
    "op7_exact_dedup": EXACT_DEDUP_SQL,
    "op8_line_dedup": LINE_DEDUP_SQL,
    "op9_secret_scan": SECRET_SCAN_SQL,
    "op11_periodic_runs": PERIODIC_RUNS_SQL,
    "op12_ranked_search": LEXICAL_SEARCH_SQL,
}
