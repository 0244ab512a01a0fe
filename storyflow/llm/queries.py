"""The queries of this subpackage's operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, decontamination, language, licenses, lm_scoring, packing, prefix_trie, secrets, sharding, simhash, token_counts, token_store, topk

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_secret_links": secrets.op1_secret_links,
    "op2_winnow_decontamination": decontamination.op2_winnow_decontamination,
    "op3_wavelet_store": token_store.op3_wavelet_store,
    "op4_nra_top_k": topk.op4_nra_top_k,
    "op5_license_join": licenses.op5_license_join,
    "op6_digest_counts": token_counts.op6_digest_counts,
    "op7_simhash_groups": simhash.op7_simhash_groups,
    "op8_two_pass_shards": sharding.op8_two_pass_shards,
    "op9_nnls_packing": packing.op9_nnls_packing,
    "op10_ppm_language": language.op10_ppm_language,
    "op11_collocations": collocations.op11_collocations,
    "op12_trie_scores": lm_scoring.op12_trie_scores,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

SQL: dict[str, str] = {
    "op1_secret_links": secrets.SQL,
    "op2_winnow_decontamination": decontamination.SQL,
    "op4_nra_top_k": topk.SQL,
    "op5_license_join": licenses.SQL,
    "op11_collocations": collocations.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
