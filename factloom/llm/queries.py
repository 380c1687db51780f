"""The queries of this subpackage and the SQL of those that SQL can express."""

from . import bloom_lm, bpe, chat, decontaminate, html_text, kd_shards, line_dedup, ngram_join, periodic_runs, quality, spelling, tiff, token_scan

QUERIES = {
    "op1_html_text": html_text.op1_html_text,
    "op2_token_counts": token_scan.op2_token_counts,
    "op3_perspectives": chat.op3_perspectives,
    "op4_tiff": tiff.op4_tiff,
    "op5_bpe": bpe.op5_bpe,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_kd_shards": kd_shards.op8_kd_shards,
    "op9_bloom_lm": bloom_lm.op9_bloom_lm,
    "op10_quality": quality.op10_quality,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_spelling": spelling.op12_spelling,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}
ORACLE_SQL = {"op2_token_counts": token_scan.ORACLE_SQL, "op3_perspectives": chat.ORACLE_SQL, "op11_line_dedup": line_dedup.ORACLE_SQL}
