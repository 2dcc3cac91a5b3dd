"""Registered queries of the corpus operators and their DuckDB oracle SQL (where SQL can
express them)."""

from __future__ import annotations

import corpus_pipeline
from rampart.llm.ann import op4_projected_neighbours
from rampart.llm.decontaminate import op8_simhash_decontamination
from rampart.llm.hard_negatives import ORACLE_SQL as HARD_NEGATIVES_SQL
from rampart.llm.hard_negatives import op12_hard_negatives
from rampart.llm.langid import op5_language_id
from rampart.llm.line_dedup import ORACLE_SQL as LINE_DEDUP_SQL
from rampart.llm.line_dedup import op3_line_dedup
from rampart.llm.minhash_dedup import op9_minhash_dedup
from rampart.llm.packing import op1_sum_of_squares_packing
from rampart.llm.sentence_pieces import op11_sentence_pieces
from rampart.llm.spelling import op13_spelling_variants
from rampart.llm.substring_dedup import op2_substring_dedup
from rampart.llm.suffix_dedup import op6_suffix_dedup
from rampart.llm.token_files import op10_token_files
from rampart.llm.warc import op7_warc_histories

QUERIES = {
    "op1_sum_of_squares_packing": op1_sum_of_squares_packing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_projected_neighbours": op4_projected_neighbours,
    "op5_language_id": op5_language_id,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_warc_histories": op7_warc_histories,
    "op8_simhash_decontamination": op8_simhash_decontamination,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_token_files": op10_token_files,
    "op11_sentence_pieces": op11_sentence_pieces,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_spelling_variants": op13_spelling_variants,
    "pipeline": corpus_pipeline.run,
}

ORACLE: dict[str, str] = {"op3_line_dedup": LINE_DEDUP_SQL, "op12_hard_negatives": HARD_NEGATIVES_SQL}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
