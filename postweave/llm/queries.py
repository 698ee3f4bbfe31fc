"""The registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from .fingerprints import op7_fingerprints
from .hard_negatives import OP12_SQL, op12_hard_negatives
from .html_extract import op10_main_text
from .near_dedup import op1_near_dedup
from .neighbours import op9_nearest_neighbours
from .ngram_join import components_sql, op11_ngram_join
from .packing import op3_best_fit_packing
from .private_data import op8_private_data
from .quality import op4_quality_classifier
from .token_counts import op2_token_counts
from .url_filter import op5_url_filter
from .whitening import op13_embedding_whitening
from .word_codes import op6_bpe_codes

QUERIES = {f.__name__: f for f in (
    op1_near_dedup, op2_token_counts, op3_best_fit_packing, op4_quality_classifier, op5_url_filter, op6_bpe_codes, op7_fingerprints, op8_private_data,
    op9_nearest_neighbours, op10_main_text, op11_ngram_join, op12_hard_negatives, op13_embedding_whitening)}
ORACLES: dict[str, str] = {
    "op1_near_dedup": components_sql(80, 4, kept=True), "op11_ngram_join": components_sql(85, 4, kept=False), "op12_hard_negatives": OP12_SQL}
