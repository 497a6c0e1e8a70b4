"""The named queries of this package and their SQL counterparts."""

from __future__ import annotations

from orbitway.llm import html_text, lattice_links, media, mixing, ngram_scores, pieces, repeats, simhash, token_files, topk, toxicity, whitening, word_runs

QUERIES = {
    "op1_topk": topk.op1_topk,
    "op2_mixing": mixing.op2_mixing,
    "op3_simhash": simhash.op3_simhash,
    "op4_media": media.op4_media,
    "op5_token_files": token_files.op5_token_files,
    "op6_html": html_text.op6_html,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_repeats": repeats.op9_repeats,
    "op10_ngram_scores": ngram_scores.op10_ngram_scores,
    "op11_lattice_links": lattice_links.op11_lattice_links,
    "op12_whitening": whitening.op12_whitening,
    "op13_word_runs": word_runs.op13_word_runs,
}
ORACLE = {"op1_topk": topk.SQL, "op2_mixing": mixing.SQL, "op10_ngram_scores": ngram_scores.SQL}
