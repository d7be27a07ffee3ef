"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .decontaminate import op3_edit_leaks
from .flac import op4_flac
from .html_text import op10_html_crf
from .language import op6_language_nb
from .pieces import op2_piece_lattice
from .quality import op8_quality_embeddings
from .sharding import op9_interleave
from .simhash import op1_simhash_vptree
from .substring_dedup import op5_suffix_dedup
from .url_rules import op7_url_rules


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_simhash_vptree, op2_piece_lattice, op3_edit_leaks, op4_flac, op5_suffix_dedup, op6_language_nb, op7_url_rules, op8_quality_embeddings, op9_interleave, op10_html_crf, pipeline)}

#: None of them: XXH64 and CRC-32, sampled lattices, edit distances, FLAC, suffix arrays, trained models and mined rules are
#: beyond the SQL at hand, or too slow on whole tables. tests/llm holds each against brute force.
ORACLE_SQL: dict[str, str] = {}
