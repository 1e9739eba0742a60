"""The queries opN_<name> of this subpackage and, where SQL can express them, their SQL."""

from . import bpe, chat, chunks, decontaminate, hmm, language, runindex, secrets, simhash, topk

QUERIES = {
    "op1_preference": chat.op1_preference,
    "op2_threshold": topk.op2_threshold,
    "op3_simhash": simhash.op3_simhash,
    "op4_language": language.op4_language,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_hmm": hmm.op6_hmm,
    "op7_gear": chunks.op7_gear,
    "op8_run_index": runindex.op8_run_index,
    "op9_winnowing": decontaminate.op9_winnowing,
    "op10_secrets": secrets.op10_secrets,
}
SQL = chat.SQL | topk.SQL | decontaminate.SQL | secrets.SQL
