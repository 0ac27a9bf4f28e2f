"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from quarry.llm import embeddings, langid, lm, media, minhash, mixing, packing, quality, toxicity, warc

QUERIES = {
    "op1_lm": lm.op1_lm,
    "op2_media": media.op2_media,
    "op3_minhash": minhash.op3_minhash,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_quality": quality.op5_quality,
    "op6_langid": langid.op6_langid,
    "op7_packing": packing.op7_packing,
    "op8_embeddings": embeddings.op8_embeddings,
    "op9_warc": warc.op9_warc,
    "op10_mixing": mixing.op10_mixing,
}

ORACLE_SQL = {
    "op3_minhash": minhash.OP3_SQL,
    "op8_embeddings": embeddings.OP8_SQL,
    "op9_warc": warc.OP9_SQL,
}
