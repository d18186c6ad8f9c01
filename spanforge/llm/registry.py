"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, decontam, langid, lattice, mixing, puquality, simhash, styletree, topk, toxicity

QUERIES = {
    "op1_langid": langid.query,
    "op2_mixing": mixing.query,
    "op3_quality": puquality.query,
    "op4_chat": chat.query,
    "op5_toxicity": toxicity.query,
    "op6_simhash": simhash.query,
    "op7_styletree": styletree.query,
    "op8_topk": topk.query,
    "op9_decontam": decontam.query,
    "op10_lattice": lattice.query,
}

#: The others can't be told in SQL, or not at these sizes: models, connected components, page trees and lattices. The tests hold them against plain versions.
ORACLE_SQL = {
    "op4_chat": chat.SQL,
    "op8_topk": topk.SQL,
    "op9_decontam": decontam.SQL,
}
