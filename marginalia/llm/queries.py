"""The registered queries of this subpackage and, where SQL can express one, its DuckDB form."""

from __future__ import annotations

from . import decontaminate, infill, language, mixing, order_minhash, quotations, secrets, simhash, substrings, token_shards, toxicity, vector_codes, warc

QUERIES = {
    "op1_simhash_near_dedup": simhash.query,
    "op2_secret_scan": secrets.query,
    "op3_order_minhash": order_minhash.query,
    "op4_warc_archive": warc.query,
    "op5_benchmark_decontamination": decontaminate.query,
    "op6_quotation_linking": quotations.query,
    "op7_toxicity": toxicity.query,
    "op8_language_id": language.query,
    "op9_substring_dedup": substrings.query,
    "op10_source_mixing": mixing.query,
    "op11_vector_codes": vector_codes.query,
    "op12_fill_in_middle": infill.query,
    "op13_token_shards": token_shards.query,
}

ORACLE_SQL: dict[str, str] = {
    "op4_warc_archive": warc.SQL,
    "op6_quotation_linking": quotations.SQL,
    "op11_vector_codes": vector_codes.SQL,
    "op12_fill_in_middle": infill.SQL,
}
