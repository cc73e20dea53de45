"""Registry of the training-data queries and their SQL."""

import corpus_pipeline
from strictpast.llm import ann, exact_dedup, html_extract, langid, maxent_lm, mixing, packing, sharding, simhash, toxicity

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_ann": ann.op1_ann,
    "op2_packing": packing.op2_packing,
    "op3_langid": langid.op3_langid,
    "op4_simhash": simhash.op4_simhash,
    "op5_lm_score": maxent_lm.op5_lm_score,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_mixing": mixing.op7_mixing,
    "op8_html": html_extract.op8_html,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_sharding": sharding.op10_sharding,
}

ORACLES = {
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op10_sharding": sharding.sharding_sql(),
}
