"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from cloakwork.llm import exact_dedup, filter_audit, hard_negatives, ngram_join
from cloakwork.llm.exact_dedup import op8_exact_dedup
from cloakwork.llm.filter_audit import op13_filter_audit
from cloakwork.llm.forced_bpe import op12_forced_bpe
from cloakwork.llm.hard_negatives import op11_hard_negatives
from cloakwork.llm.language_id import op5_language_id
from cloakwork.llm.mixing import op4_mix_sources
from cloakwork.llm.ngram_join import op3_ngram_join
from cloakwork.llm.piece_bpe import op2_piece_round_trip
from cloakwork.llm.quality import op6_quality
from cloakwork.llm.sharding import op1_kd_shards
from cloakwork.llm.tiff_media import op10_tiff_media
from cloakwork.llm.token_store import op9_token_store
from cloakwork.llm.toxicity import op7_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_kd_shards, op2_piece_round_trip, op3_ngram_join, op4_mix_sources, op5_language_id,
        op6_quality, op7_toxicity, op8_exact_dedup, op9_token_store, op10_tiff_media,
        op11_hard_negatives, op12_forced_bpe, op13_filter_audit,
    )
}

ORACLE_SQL = {"op3_ngram_join": ngram_join.OP3_SQL, "op8_exact_dedup": exact_dedup.OP8_SQL, "op11_hard_negatives": hard_negatives.OP11_SQL, "op13_filter_audit": filter_audit.OP13_SQL}
