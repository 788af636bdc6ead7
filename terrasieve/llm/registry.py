"""Queries of the text operators, and the SQL that checks them where SQL can."""

from __future__ import annotations

from . import align, bpe, centroids, gru, jaccard, jump, mixture, mpeg, phrases, simhash, suffixes, trie, wavelet

QUERIES = {
    "op1_suffix_decontamination": suffixes.op1_suffix_decontamination,
    "op2_mpeg_media": mpeg.op2_mpeg_media,
    "op3_language_mixture": mixture.op3_language_mixture,
    "op4_simhash": simhash.op4_simhash,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_wavelet_ids": wavelet.op6_wavelet_ids,
    "op7_gru_scores": gru.op7_gru_scores,
    "op8_jump_shards": jump.op8_jump_shards,
    "op9_phrase_parsing": phrases.op9_phrase_parsing,
    "op10_line_alignment": align.op10_line_alignment,
    "op11_weighted_clusters": centroids.op11_weighted_clusters,
    "op12_jaccard_regions": jaccard.op12_jaccard_regions,
    "op13_prefix_trie": trie.op13_prefix_trie,
}

SQL: dict[str, str] = {
    "op11_weighted_clusters": centroids.OP11_SQL,
    "op12_jaccard_regions": jaccard.OP12_SQL,
    "op13_prefix_trie": trie.OP13_SQL,
}
