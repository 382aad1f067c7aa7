"""Registered queries of the training-data operators, with SQL where DuckDB can express them."""

from __future__ import annotations

from graphloom.llm import chat, decontamination, language_id, mixing, quality, simhash, token_output, transport_stream, url_filter, warc

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_chat_format": chat.op3_chat_format,
    "op4_warc": warc.op4_warc,
    "op5_transport_stream": transport_stream.op5_transport_stream,
    "op6_decontaminate": decontamination.op6_decontaminate,
    "op7_token_ids": token_output.op7_token_ids,
    "op8_mixing": mixing.op8_mixing,
    "op9_simhash": simhash.op9_simhash,
    "op10_quality": quality.op10_quality,
}

ORACLE_SQL = {
    "op2_url_filter": url_filter.ORACLE,
    "op3_chat_format": chat.ORACLE,
    "op4_warc": warc.ORACLE,
    "op6_decontaminate": decontamination.ORACLE,
    "op8_mixing": mixing.ORACLE,
}
