"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from learntrail.llm.alignment import op13_alignment
from learntrail.llm.bpe import op11_bpe
from learntrail.llm.decontam import op10_decontamination
from learntrail.llm.embeddings import op8_embeddings
from learntrail.llm.minhash import op6_minhash
from learntrail.llm.packing import op9_packing
from learntrail.llm.pii import op1_pii
from learntrail.llm.preference import OP3_SQL, op3_preferences
from learntrail.llm.quality import op5_quality
from learntrail.llm.repair import op12_repair
from learntrail.llm.substring import op7_substring
from learntrail.llm.tokens import op4_token_counts
from learntrail.llm.toxicity import op2_toxicity

QUERIES = {f.__name__: f for f in (op1_pii, op2_toxicity, op3_preferences, op4_token_counts, op5_quality, op6_minhash, op7_substring, op8_embeddings, op9_packing, op10_decontamination, op11_bpe, op12_repair, op13_alignment)}
SQL = {"op3_preferences": OP3_SQL}
