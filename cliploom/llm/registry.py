"""Queries of this subpackage and the SQL that DuckDB can hold them against."""

from __future__ import annotations

from .attention_mil import op11_quality_mil
from .bin_packing import op10_bin_packing
from .bpe_transducer import op8_token_counts
from .embedding_dedup import OP5_SQL, op5_embedding_dedup
from .importance_resampling import op12_importance_resampling
from .lm_score import op3_lm_score
from .merkle_manifest import op13_merkle_manifest
from .ngram_join import OP7_SQL, op7_ngram_join
from .quality_llr import op4_quality_llr
from .secret_scan import op1_secret_scan
from .source_mix import OP9_SQL, op9_source_mix
from .url_filter import op6_url_filter
from .warc_convert import OP2_SQL, op2_warc_convert

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_warc_convert": op2_warc_convert,
    "op3_lm_score": op3_lm_score,
    "op4_quality_llr": op4_quality_llr,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_ngram_join": op7_ngram_join,
    "op8_token_counts": op8_token_counts,
    "op9_source_mix": op9_source_mix,
    "op10_bin_packing": op10_bin_packing,
    "op11_quality_mil": op11_quality_mil,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: Where SQL can express the query; the others are tested against brute force in tests/llm.
ORACLES = {
    "op2_warc_convert": OP2_SQL,
    "op5_embedding_dedup": OP5_SQL,
    "op7_ngram_join": OP7_SQL,
    "op9_source_mix": OP9_SQL,
}
