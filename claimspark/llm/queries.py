"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from . import chat_format, exact_dedup, hmm_lm, language_id, mixing, packing, pii, prefix_forest, secret_scan, simhash

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_mixing": mixing.op2_mixing,
    "op3_language_id": language_id.op3_language_id,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_simhash": simhash.op5_simhash,
    "op6_packing": packing.op6_packing,
    "op7_chat_format": chat_format.op7_chat_format,
    "op8_prefix_forest": prefix_forest.op8_prefix_forest,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_hmm_lm": hmm_lm.op10_hmm_lm,
}

ORACLE_SQL = {
    "op2_mixing": mixing.OP2_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
}
