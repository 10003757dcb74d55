"""Schemas of every table that is read or written."""

from doselab.operators.match import WORDS_TYPE

RECORD = "domain string, text string"
SENTENCE = f"sent_id bigint, source_domain string, text string, word_count int, words {WORDS_TYPE}"
EVAL_ITEM = "item_id string, construction string, good_sentence string, bad_sentence string, minimal_pair_type string, source string, notes string"
EVAL_RESULT = "model_construction string, dose string, seed int, eval_construction string, n_pairs int, n_correct int, accuracy double, std_error double"
PER_ITEM = "model_construction string, dose string, seed int, eval_construction string, item_id string, slor_good double, slor_bad double, correct int"
AUDIT = "sentence_id bigint, sentence_text string, filter_label int, human_label string, notes string"
HILL_FIT = "construction string, seed int, is_core boolean, E0 double, Emax double, E50 double, n double, r_squared double, converged boolean"
