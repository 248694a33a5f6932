"""Operators for large training-data pipelines, with the queries registered for them."""

from tripleloom.llm.decontaminate import op3_decontamination
from tripleloom.llm.hilbert_pack import op10_hilbert_packing
from tripleloom.llm.html_consensus import op9_main_text
from tripleloom.llm.license_scan import op7_licenses
from tripleloom.llm.line_dedup import OP11_SQL, op11_line_dedup
from tripleloom.llm.prefix_trie import OP12_SQL, op12_prefix_trie
from tripleloom.llm.quality_crf import op2_quality
from tripleloom.llm.rule_ledger import OP8_SQL, op8_quality_rules
from tripleloom.llm.secret_scan import op5_secrets
from tripleloom.llm.simhash_pivots import op6_simhash
from tripleloom.llm.token_alignment import op13_token_alignment
from tripleloom.llm.token_counts import op4_token_counts
from tripleloom.llm.toxicity import op1_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_quality, op3_decontamination, op4_token_counts, op5_secrets, op6_simhash,
        op7_licenses, op8_quality_rules, op9_main_text, op10_hilbert_packing, op11_line_dedup,
        op12_prefix_trie, op13_token_alignment,
    )
}
ORACLES = {"op8_quality_rules": OP8_SQL, "op11_line_dedup": OP11_SQL, "op12_prefix_trie": OP12_SQL}
