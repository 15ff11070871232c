"""The queries of this folder, and the SQL that gives the same rows where SQL can."""

from gridgraph.llm import chat, decontaminate, html_text, language_id, license_scan, line_dedup, ngram_join, pivot_search, sentencepiece_codec, warc

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_language": language_id.op4_language,
    "op5_sentencepiece": sentencepiece_codec.op5_sentencepiece,
    "op6_topk": pivot_search.op6_topk,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_html": html_text.op8_html,
    "op9_warc": warc.op9_warc,
    "op10_chat": chat.op10_chat,
}

ORACLE_SQL = {
    "op1_license_scan": license_scan.OP1_SQL,
    "op2_decontamination": decontaminate.OP2_SQL,
    "op6_topk": pivot_search.OP6_SQL,
    "op9_warc": warc.OP9_SQL,
    "op10_chat": chat.OP10_SQL,
}
