"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from tidemark.llm.cover_tree import op6_embedding_near_dedup
from tidemark.llm.html_text import op2_html_extraction
from tidemark.llm.language import op10_language_id
from tidemark.llm.license_scan import op7_license_scan
from tidemark.llm.line_dedup import op3_line_dedup
from tidemark.llm.mixing import op4_mixing
from tidemark.llm.order_minhash import op1_order_minhash
from tidemark.llm.packing import op9_best_fit_packing
from tidemark.llm.periodic_runs import op13_periodic_runs
from tidemark.llm.quality_rules import op11_quality_rules
from tidemark.llm.simhash import op5_simhash_near_dedup
from tidemark.llm.toxicity import op8_toxicity
from tidemark.llm.whitening import op12_embedding_whitening

QUERIES = {
    f.__name__: f
    for f in (op1_order_minhash, op2_html_extraction, op3_line_dedup, op4_mixing, op5_simhash_near_dedup, op6_embedding_near_dedup, op7_license_scan, op8_toxicity, op9_best_fit_packing, op10_language_id,
              op11_quality_rules, op12_embedding_whitening, op13_periodic_runs)
}
#: They need hashes, trained models, trees or tokenizers that SQL lacks; tests/llm holds them against brute force.
SQL: dict[str, str] = {}
