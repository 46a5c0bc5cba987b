"""Queries of this subpackage by name, and SQL where SQL can express them."""

import corpus_pipeline
from lorespark.llm import decontaminate, langid, linededup, mixing, multiindex, pii, simhash, tokens, warc, wavelet

QUERIES = {
    "op1_warc_derivatives": warc.op1_warc_derivatives,
    "op2_simhash_dedup": simhash.op2_simhash_dedup,
    "op3_language_id": langid.op3_language_id,
    "op4_line_dedup": linededup.op4_line_dedup,
    "op5_wavelet_tokens": wavelet.op5_wavelet_tokens,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_pii_spans": pii.op7_pii_spans,
    "op8_token_counts": tokens.op8_token_counts,
    "op9_embedding_dedup": multiindex.op9_embedding_dedup,
    "op10_mix_sources": mixing.op10_mix_sources,
    "pipeline": corpus_pipeline.run,
}
ORACLE = {
    "op4_line_dedup": linededup.SQL,
    "op6_decontaminate": decontaminate.SQL,
    "op10_mix_sources": mixing.SQL,
}
