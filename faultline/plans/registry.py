"""Registered queries and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from faultline.plans import analysis, collected, corpus, labelling, roundtrips

ANALYSIS = [
    "project_matrix", "type_counts", "label_recode", "matrix_long", "matrix_summary", "type_share",
    "key_normalize_join", "unmatched_keys", "project_order", "typed_attributes", "numeric_profile",
    "attribute_overview", "domain_medians", "domain_matrix", "domain_zscores", "domain_distance",
    "midranks", "spearman_attrs", "corr_transposed", "spearman_types", "corr_edges",
    "spearman_cross", "fanout_sum", "spearman_pvalues", "kruskal_wallis",
]


CORPUS = {
    "clean_tokens": corpus.clean_tokens_q, "token_counts": corpus.token_counts,
    "fix_title_filter": corpus.fix_title_filter, "conversation_text": corpus.conversation_text,
    "conversation_size": corpus.conversation_size, "nested_record": corpus.nested_record,
    "bot_filter": corpus.bot_filter, "role_filter": corpus.role_filter,
    "before_after_pairs": corpus.before_after_pairs, "event_props_json": corpus.event_props_json,
    "time_window_limit": corpus.time_window_limit, "page_links": corpus.page_links,
    "page_title": corpus.page_title, "page_main_text": corpus.page_main_text,
    "page_quarantine": corpus.page_quarantine, "two_hop_links": corpus.two_hop_links,
    "url_parts": corpus.url_parts, "page_block_text": corpus.page_block_text,
    "collected_links": collected.collected_links, "collected_records": collected.collected_records,
    "page_quarantine_kinds": collected.page_quarantine_kinds, "page_kind_counts": collected.page_kind_counts,
    "event_props_keys": corpus.event_props_keys, "lexicon_lemmas": corpus.lexicon_lemmas, "lexicon_tokens": corpus.lexicon_tokens,
}


LABELLING = [
    "verify_predictions", "confusion_counts", "category_summary", "coverage_summary",
    "category_by_repo", "label_set_ops", "train_set", "predict_set", "contrastive_pairs",
    "classify_embeddings", "classify_tasks", "classify_checks", "prediction_accuracy",
    "task_category_pairs", "class_measures", "oversampled_pairs", "projection_checks",
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in ANALYSIS:
        out[name] = getattr(analysis, name)
    out.update(CORPUS)
    for name in LABELLING:
        out[name] = getattr(labelling, name)
    for name in roundtrips.QUERIES:
        out[name] = getattr(roundtrips, name)
    return out


def oracle_sql() -> dict[str, str]:
    from faultline.plans.oracles import analysis_oracles, corpus_oracles, labelling_oracles
    out = dict(analysis_oracles())
    out.update(corpus_oracles())
    out.update(labelling_oracles())
    out.update(collected.oracles())
    out.update(roundtrips.oracles())
    return out
