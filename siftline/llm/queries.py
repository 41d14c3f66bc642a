"""The subpackage's registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, decontam, divergence, langid, lines, lmscore, manifest, ogg, quality, setjoin, tokenfile, toxicity, warc


def queries():
    return {
        "op1_ngram_jaccard": setjoin.op1_ngram_jaccard,
        "op2_token_file": tokenfile.op2_token_file,
        "op3_decontamination": decontam.op3_decontamination,
        "op4_line_dedup": lines.op4_line_dedup,
        "op5_ogg_media": ogg.op5_ogg_media,
        "op6_bpe": bpe.op6_bpe,
        "op7_lm_scoring": lmscore.op7_lm_scoring,
        "op8_warc_revisits": warc.op8_warc_revisits,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_language_id": langid.op10_language_id,
        "op11_quality": quality.op11_quality,
        "op12_merkle_manifest": manifest.op12_merkle_manifest,
        "op13_source_divergence": divergence.op13_source_divergence,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {"op4_line_dedup": lines.OP4_SQL, "op12_merkle_manifest": manifest.OP12_SQL, "op13_source_divergence": divergence.OP13_SQL}
