"""The queries of the text operators, each over its whole table."""

from parcelwise.llm import (
    binary_ids, merge_replay, merkle, packing, periodic_runs, perplexity, phrase_index, pii, quality_model, simhash,
    token_counts, url_filter, winnow,
)

QUERIES = {
    "op1_personal_data": pii.query,
    "op2_url_rules": url_filter.query,
    "op3_token_counts": token_counts.query,
    "op4_simhash_groups": simhash.query,
    "op5_quality_scores": quality_model.query,
    "op6_id_files": binary_ids.query,
    "op7_merge_replay": merge_replay.query,
    "op8_quality_rules": perplexity.query,
    "op9_packing": packing.query,
    "op10_winnowing": winnow.query,
    "op11_decontamination": phrase_index.query,
    "op12_merkle_manifest": merkle.query,
    "op13_periodic_runs": periodic_runs.query,
}

ORACLE = {"op2_url_rules": url_filter.SQL, "op11_decontamination": phrase_index.SQL, "op12_merkle_manifest": merkle.SQL}
