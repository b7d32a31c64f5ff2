"""Registered queries of this folder and their SQL twins."""

from __future__ import annotations

from . import embed, langid, minhash, mixing, negatives, pieces, prints, quality, sharding, suffixes, tokenlinks, topk, toxicity

QUERIES = {
    "op1_suffixes": suffixes.op1_suffixes,
    "op2_mixing": mixing.op2_mixing,
    "op3_minhash": minhash.op3_minhash,
    "op4_prints": prints.op4_prints,
    "op5_langid": langid.op5_langid,
    "op6_pieces": pieces.op6_pieces,
    "op7_sharding": sharding.op7_sharding,
    "op8_quality": quality.op8_quality,
    "op9_embed": embed.op9_embed,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_topk": topk.op11_topk,
    "op12_negatives": negatives.op12_negatives,
    "op13_tokenlinks": tokenlinks.op13_tokenlinks,
}

SQL = {"op2_mixing": mixing.OP2_SQL, "op11_topk": topk.OP11_SQL, "op12_negatives": negatives.OP12_SQL}
