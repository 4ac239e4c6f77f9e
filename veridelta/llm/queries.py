"""The registered queries of this subpackage and their SQL."""

from veridelta.llm import align, bpe, collocations, covertree, dac, exact, packing, pii, simhash, suffixtree, topk, toxicity, urls

QUERIES = {
    "op1_topk": topk.op1_topk,
    "op2_bpe": bpe.op2_bpe,
    "op3_pii": pii.op3_pii,
    "op4_tokens": dac.op4_tokens,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_suffixtree": suffixtree.op6_suffixtree,
    "op7_urls": urls.op7_urls,
    "op8_simhash": simhash.op8_simhash,
    "op9_packing": packing.op9_packing,
    "op10_covertree": covertree.op10_covertree,
    "op11_exact": exact.op11_exact,
    "op12_alignment": align.op12_alignment,
    "op13_collocations": collocations.op13_collocations,
}
ORACLES = {
    "op1_topk": topk.SQL,
    "op7_urls": urls.SQL,
    "op10_covertree": covertree.SQL,
    "op11_exact": exact.SQL,
    "op13_collocations": collocations.SQL,
}
