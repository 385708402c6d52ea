"""The queries of this subpackage and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from . import embedding_dedup, exact_dedup, fill_middle, filter_audit, html_text, line_dedup, mixing, piece_codec, quality, simhash, token_files, toxicity, warc_fixity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_warc_fixity": warc_fixity.op2_warc_fixity,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_sentencepiece": piece_codec.op5_sentencepiece,
    "op6_simhash": simhash.op6_simhash,
    "op7_embedding_dedup": embedding_dedup.op7_embedding_dedup,
    "op8_token_ids": token_files.op8_token_ids,
    "op9_mixing": mixing.op9_mixing,
    "op10_html_text": html_text.op10_html_text,
    "op11_quality": quality.op11_quality,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_fill_middle": fill_middle.op13_fill_middle,
}

SQL = {
    "op2_warc_fixity": warc_fixity.SQL,
    "op3_line_dedup": line_dedup.SQL,
    "op4_exact_dedup": exact_dedup.SQL,
    "op9_mixing": mixing.SQL,
    "op12_filter_audit": filter_audit.SQL,
    "op13_fill_middle": fill_middle.SQL,
}
