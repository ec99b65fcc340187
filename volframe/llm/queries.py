"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from . import clustering, compression_classifier, media, minhash, ngram_join, packing, prefix_trie, quality_rules, sentencepieces, sharding, token_counts, url_filters, warc

QUERIES = {
    "op1_sentencepieces": sentencepieces.op1,
    "op2_token_counts": token_counts.op2,
    "op3_ngram_join": ngram_join.op3,
    "op4_url_filters": url_filters.op4,
    "op5_packing": packing.op5,
    "op6_quality_classifier": compression_classifier.op6,
    "op7_media_columns": media.op7,
    "op8_sharding": sharding.op8,
    "op9_warc": warc.op9,
    "op10_quality_rules": quality_rules.op10,
    "op11_centroid_clustering": clustering.op11,
    "op12_prefix_trie": prefix_trie.op12,
    "op13_minhash_dedup": minhash.op13,
}
ORACLE_SQL = {
    "op3_ngram_join": ngram_join.ORACLE,
    "op4_url_filters": url_filters.ORACLE,
    "op9_warc": warc.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
    "op11_centroid_clustering": clustering.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
    "op13_minhash_dedup": minhash.ORACLE,
}
