"""The queries of this subpackage and the SQL that checks them."""

from ledgerloom.llm import bitsliced, chat, collocations, decontaminate, html, lm, packing, quality, sharding, simhash, spans, templates, trie

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_chat_format": chat.op3_chat_format,
    "op4_lm_score": lm.op4_lm_score,
    "op5_quality": quality.op5_quality,
    "op6_line_templates": templates.op6_line_templates,
    "op7_packing": packing.op7_packing,
    "op8_html_text": html.op8_html_text,
    "op9_topk": bitsliced.op9_topk,
    "op10_sentence_spans": spans.op10_sentence_spans,
    "op11_collocations": collocations.op11_collocations,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_sharding": sharding.op13_sharding,
}

ORACLE_SQL = {
    "op2_decontamination": decontaminate.OP2_SQL,
    "op3_chat_format": chat.OP3_SQL,
    "op9_topk": bitsliced.OP9_SQL,
    "op11_collocations": collocations.OP11_SQL,
    "op12_prefix_trie": trie.OP12_SQL,
    "op13_sharding": sharding.OP13_SQL,
}
