"""Queries of the training-data operators, and SQL for those that it can express."""

from placekit.llm import best_fit_packing, class_language_model, exact_top_k, media_columns, ngram_jaccard_join, quality_classifier, secret_scans, sharding, source_mixing, suffix_array_dedup

QUERIES = {
    "op1_secret_scans": secret_scans.op1_secret_scans,
    "op2_sharding": sharding.op2_sharding,
    "op3_ngram_jaccard_join": ngram_jaccard_join.op3_ngram_jaccard_join,
    "op4_media_columns": media_columns.op4_media_columns,
    "op5_source_mixing": source_mixing.op5_source_mixing,
    "op6_quality_classifier": quality_classifier.op6_quality_classifier,
    "op7_class_language_model": class_language_model.op7_class_language_model,
    "op8_suffix_array_dedup": suffix_array_dedup.op8_suffix_array_dedup,
    "op9_best_fit_packing": best_fit_packing.op9_best_fit_packing,
    "op10_exact_top_k": exact_top_k.op10_exact_top_k,
}

ORACLE_SQL = {"op10_exact_top_k": exact_top_k.ORACLE_SQL}
