"""The queries of this subpackage and, where SQL can express them, their SQL."""

from palimpsest.llm import bpe, html, langid, licence, linededup, merkle, mixing, ngramjoin, ogg, quality, sharding, sketch, vectorcodes

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_ogg": ogg.op2_ogg,
    "op3_langid": langid.op3_langid,
    "op4_linededup": linededup.op4_linededup,
    "op5_sharding": sharding.op5_sharding,
    "op6_fingerprint": sketch.op6_fingerprint,
    "op7_html": html.op7_html,
    "op8_quality": quality.op8_quality,
    "op9_bpe": bpe.op9_bpe,
    "op10_ngram": ngramjoin.op10_ngram,
    "op11_merkle": merkle.op11_merkle,
    "op12_licences": licence.op12_licences,
    "op13_vector_codes": vectorcodes.op13_vector_codes,
}

ORACLES: dict[str, str] = {
    "op1_mixing": mixing.oracle(),
    "op11_merkle": merkle.oracle(),
    "op13_vector_codes": vectorcodes.oracle(),
}
