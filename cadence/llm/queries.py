"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from cadence.llm.alignment import op11_byte_owners
from cadence.llm.chat import OP5_SQL, op5_chat_format
from cadence.llm.collisions import OP3_SQL, op3_collision_links
from cadence.llm.extraction import op12_block_rules
from cadence.llm.forest import op1_prefix_forest
from cadence.llm.lines import op6_line_alignment
from cadence.llm.minhash import OP2_SQL, op2_circulant_minhash
from cadence.llm.mixing import OP9_SQL, op9_mix_sources
from cadence.llm.negatives import OP13_SQL, op13_distance_keys
from cadence.llm.packing import op8_pack_sequences
from cadence.llm.quality import op10_quality_votes
from cadence.llm.secrets import OP7_SQL, op7_secret_ledger
from cadence.llm.substrings import OP4_SQL, op4_repeated_windows

QUERIES = {
    "op1_prefix_forest": op1_prefix_forest,
    "op2_circulant_minhash": op2_circulant_minhash,
    "op3_collision_links": op3_collision_links,
    "op4_repeated_windows": op4_repeated_windows,
    "op5_chat_format": op5_chat_format,
    "op6_line_alignment": op6_line_alignment,
    "op7_secret_ledger": op7_secret_ledger,
    "op8_pack_sequences": op8_pack_sequences,
    "op9_mix_sources": op9_mix_sources,
    "op10_quality_votes": op10_quality_votes,
    "op11_byte_owners": op11_byte_owners,
    "op12_block_rules": op12_block_rules,
    "op13_distance_keys": op13_distance_keys,
}
ORACLES = {
    "op2_circulant_minhash": OP2_SQL,
    "op3_collision_links": OP3_SQL,
    "op4_repeated_windows": OP4_SQL,
    "op5_chat_format": OP5_SQL,
    "op7_secret_ledger": OP7_SQL,
    "op9_mix_sources": OP9_SQL,
    "op13_distance_keys": OP13_SQL,
}
