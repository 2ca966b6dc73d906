"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tideline.llm import decontaminate, exact, infill, langid, licenses, lloyd, lzprint, mixing, passages, reputation, sharding, simhash, warc

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_lz_fingerprint": lzprint.op2_lz_fingerprint,
    "op3_language_id": langid.op3_language_id,
    "op4_simhash_trie": simhash.op4_simhash_trie,
    "op5_warc_chain": warc.op5_warc_chain,
    "op6_decontamination_fm": decontaminate.op6_decontamination_fm,
    "op7_host_reputation": reputation.op7_host_reputation,
    "op8_pfair_mixture": mixing.op8_pfair_mixture,
    "op9_collinear_passages": passages.op9_collinear_passages,
    "op10_stratified_shards": sharding.op10_stratified_shards,
    "op11_exact_tries": exact.op11_exact_tries,
    "op12_fill_in_middle": infill.op12_fill_in_middle,
    "op13_heap_lloyd": lloyd.op13_heap_lloyd,
}
ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": licenses.ORACLE_OP1, "op5_warc_chain": warc.ORACLE_OP5, "op6_decontamination_fm": decontaminate.ORACLE_OP6, "op7_host_reputation": reputation.ORACLE_OP7, "op8_pfair_mixture": mixing.ORACLE_OP8,
    "op10_stratified_shards": sharding.ORACLE_OP10, "op11_exact_tries": exact.ORACLE_OP11, "op12_fill_in_middle": infill.ORACLE_OP12, "op13_heap_lloyd": lloyd.ORACLE_OP13,
}
