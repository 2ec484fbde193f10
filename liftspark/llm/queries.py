"""Registry of the text operators' queries and their SQL counterparts."""

from liftspark.llm import (
    alignment,
    bundles,
    compression,
    decontaminate,
    langid,
    mixing,
    novelty,
    pieces,
    pii,
    simhash,
    suffixes,
    tries,
    urlfilter,
)

QUERIES = {
    f.__name__: f
    for f in (
        suffixes.op1_suffix_array_dedup,
        compression.op6_compression_bands,
        mixing.op2_mix_to_weights,
        pii.op3_semi_markov_pii,
        simhash.op4_simhash_near_dedup,
        urlfilter.op5_url_filter,
        langid.op8_language_id,
        bundles.op9_warc_bundles,
        novelty.op7_secret_scan,
        decontaminate.op10_benchmark_decontamination,
        alignment.op11_cross_tokenizer_alignment,
        pieces.op12_sentencepiece,
        tries.op13_conversation_trie,
    )
}
ORACLES = {
    "op9_warc_bundles": bundles.ORACLE_SQL,
    "op5_url_filter": urlfilter.ORACLE_SQL,
    "op2_mix_to_weights": mixing.ORACLE_SQL,
    "op10_benchmark_decontamination": decontaminate.ORACLE_SQL,
    "op13_conversation_trie": tries.ORACLE_SQL,
}
