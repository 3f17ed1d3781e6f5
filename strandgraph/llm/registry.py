"""Queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from strandgraph.llm import oracles, queries

QUERIES = {
    "op1_hilbert": queries.op1_hilbert,
    "op2_spotsigs": queries.op2_spotsigs,
    "op3_toxicity": queries.op3_toxicity,
    "op4_mix": queries.op4_mix,
    "op5_language": queries.op5_language,
    "op6_pieces": queries.op6_pieces,
    "op7_token_counts": queries.op7_token_counts,
    "op8_shard": queries.op8_shard,
    "op9_simhash": queries.op9_simhash,
    "op10_warc": queries.op10_warc,
    "op11_audit": queries.op11_audit,
    "op12_minhash": queries.op12_minhash,
    "op13_merkle": queries.op13_merkle,
}
ORACLE = {
    "op2_spotsigs": oracles.OP2,
    "op10_warc": oracles.OP10,
    "op11_audit": oracles.OP11,
    "op12_minhash": oracles.OP12,
    "op13_merkle": oracles.OP13,
}
