"""The numbered queries and their SQL; ``__spark_entry__`` adds them when this imports."""

from __future__ import annotations

from . import ann, exact_dedup, html_text, language_id, lm_scoring, mixing, pieces, pivots, quality, resampling, secrets, simhash, suffix_dedup


def pipeline(spark, sf_dir: str):
    """The stages of corpus_pipeline.py, in order."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_lm_scoring": lm_scoring.op1_lm_scoring,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_mixing": mixing.op3_mixing,
    "op4_simhash": simhash.op4_simhash,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_nearest": ann.op6_nearest,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_html_text": html_text.op9_html_text,
    "op10_quality": quality.op10_quality,
    "op11_centroids": pivots.op11_centroids,
    "op12_resampling": resampling.op12_resampling,
    "op13_language_id": language_id.op13_language_id,
    "pipeline": pipeline,
}

ORACLES = {
    "op1_lm_scoring": lm_scoring.SQL,
    "op3_mixing": mixing.SQL,
    "op6_nearest": ann.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
    "op11_centroids": pivots.SQL,
    "op12_resampling": resampling.SQL,
}
