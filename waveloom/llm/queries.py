"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import functools

from . import chat, common, decontaminate, language, lexical, lm, phrases, pieces, repair, simhash, suffixes, token_files, topk, warc

_QUERIES = {
    "op3_lm": lm.op3_lm,
    "op7_suffixes": suffixes.op7_suffixes,
    "op2_phrases": phrases.op2_phrases,
    "op1_topk": topk.op1_topk,
    "op4_warc": warc.op4_warc,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_simhash": simhash.op6_simhash,
    "op8_language": language.op8_language,
    "op9_pieces": pieces.op9_pieces,
    "op10_token_files": token_files.op10_token_files,
    "op11_repair": repair.op11_repair,
    "op12_chat": chat.op12_chat,
    "op13_lexical": lexical.op13_lexical,
}


def _ready(f):
    @functools.wraps(f)
    def query(spark, sf_dir):
        common.ready(spark)
        return f(spark, sf_dir)

    return query


QUERIES = {name: _ready(f) for name, f in sorted(_QUERIES.items(), key=lambda x: int(x[0][2:].split("_")[0]))}
ORACLE_SQL: dict[str, str] = {
    "op7_suffixes": phrases.ORACLE_SQL,
    "op2_phrases": phrases.ORACLE_SQL,
    "op1_topk": topk.ORACLE_SQL,
    "op4_warc": warc.ORACLE_SQL,
    "op5_decontaminate": decontaminate.ORACLE_SQL,
    "op11_repair": repair.ORACLE_SQL,
    "op12_chat": chat.ORACLE_SQL,
    "op13_lexical": lexical.ORACLE_SQL,
}
