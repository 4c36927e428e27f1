"""The registered queries of this subpackage, and DuckDB SQL where SQL can express the same rows."""

from __future__ import annotations

from . import ann, bpe, html_text, lm, minhash, packing, quality, quality_rules, resampling, sharding, toxicity, vector_codes, warc

QUERIES = {
    "op1_bpe": bpe.query,
    "op2_sharding": sharding.query,
    "op3_toxicity": toxicity.query,
    "op4_lm": lm.query,
    "op5_warc": warc.query,
    "op6_quality_rules": quality_rules.query,
    "op7_quality": quality.query,
    "op8_packing": packing.query,
    "op9_ann": ann.query,
    "op10_minhash": minhash.query,
    "op11_dsir": resampling.query,
    "op12_codes": vector_codes.query,
    "op13_html": html_text.query,
}

ORACLE_SQL = {
    "op2_sharding": sharding.oracle_sql(40),
    "op5_warc": warc.ORACLE_SQL,
    "op11_dsir": resampling.ORACLE_SQL,
    "op12_codes": vector_codes.oracle_sql(),
}
