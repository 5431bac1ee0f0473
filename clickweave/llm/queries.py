"""The registered queries of the corpus operators, and their SQL twins."""

from __future__ import annotations

from clickweave.shipping import shipped

from . import byte_bpe, chat, collocations, decontaminate, filter_audit, html_wrapper, language_id, merkle, mixing, quality, simhash, toxicity, url_filter

QUERIES = {
    f.__name__: shipped(f)
    for f in (
        chat.op1_chat_format,
        decontaminate.op2_decontamination,
        language_id.op3_language_id,
        simhash.op4_simhash,
        quality.op5_quality,
        html_wrapper.op6_html_extraction,
        toxicity.op7_toxicity,
        mixing.op8_mixing,
        merkle.op9_fingerprints,
        url_filter.op10_url_filter,
        collocations.op11_collocations,
        byte_bpe.op12_byte_bpe,
        filter_audit.op13_filter_audit,
    )
}

ORACLE_SQL = {
    "op2_decontamination": decontaminate.ORACLE_SQL,
    "op9_fingerprints": merkle.ORACLE_SQL,
    "op10_url_filter": url_filter.ORACLE_SQL,
    "op11_collocations": collocations.ORACLE_SQL,
    "op13_filter_audit": filter_audit.ORACLE_SQL,
}
