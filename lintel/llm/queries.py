"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import ann, bloomlm, bpe, exact_dedup, linededup, mixing, periodic, pii, prefixtrie, simhash, suffixdedup, tokenfiles, toxicity

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_lm": bloomlm.op3_lm,
    "op4_simhash": simhash.op4_simhash,
    "op5_pii": pii.op5_pii,
    "op6_line_dedup": linededup.op6_line_dedup,
    "op7_ann": ann.op7_ann,
    "op8_source_mixing": mixing.op8_source_mixing,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_suffix_dedup": suffixdedup.op10_suffix_dedup,
    "op11_prefix_trie": prefixtrie.op11_prefix_trie,
    "op12_token_files": tokenfiles.op12_token_files,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}

SQL = {"op5_pii": pii.SQL, "op8_source_mixing": mixing.SQL, "op9_exact_dedup": exact_dedup.SQL, "op11_prefix_trie": prefixtrie.SQL}
