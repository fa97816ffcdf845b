"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

MANIFEST = (
    "condition_id string, source_tuple_id string, question_id string, question string, y_present string, y_absent string, target_index int, target_category string, "
    "snr_db double, overlap string, distractor_count int, distractor_replicate int, included_indices array<int>, target_gain double, distractor_gain double, energy_variant string, "
    "prompt_template string, label_mapping string, semantic_answer_present boolean, absent_category string, absence_policy string, "
    "annotation_audit struct<superclass_disjoint:boolean>, selection_seed int, audit_status string, "
    "views array<struct<intervention:string,removed_index:int,audio:string,audio_sha256:string,normalization_gain:double,shared_safety_gain:double,"
    "pre_rms:double,post_rms:double,pre_peak:double,post_peak:double,surrogate_seed:int>>"
)
SCORE = (
    "condition_id string, source_tuple_id string, question_id string, target_index int, target_category string, snr_db double, overlap string, distractor_count int, "
    "distractor_replicate int, model_id string, intervention string, removed_index int, audio string, audio_sha256 string, y_present string, y_absent string, "
    "logp_present double, logp_absent double, margin double"
)
SCORE_INDEX = "panel string, model string, conditions long, views long, file string, sha256 string"
UNIT = (
    "model_id string, condition_id string, question_id string, source_tuple_id string, target_index int, target_category string, snr_db double, overlap string, "
    "distractor_count int, distractor_replicate int, off_indices array<int>, mf double, mt double, mj array<double>"
)
REPAIR_UNIT = UNIT + ", role_index int, original_source_tuple_id string, original_target_index int"
INTERFACE_UNIT = (
    "model_id string, source_tuple_id string, target_index int, prompt_template string, label_mapping string, mf double, mt double, mj array<double>, "
    "audio_paths array<string>, audio_hashes array<string>"
)
FIXED_ROW = "model_id string, question_id string, y_present string, margin double, audio_sha256 string"
ABSENT_ROW = "model_id string, prompt_template string, label_mapping string, margin double"
ENERGY_UNIT = "included_indices array<int>, target_index int, stem_rms map<string,double>, view_total_rms map<string,double>"
_VALUES = "struct<mf:double,mt:double,mj:array<double>>"
SUBST_UNIT = f"model_id string, source_tuple_id string, subst_role_id string, target_category string, condition_id string, subst_condition_id string, base {_VALUES}, subst {_VALUES}"
POSITION_BIAS = "model string, fa_yesA double, fa_yesB double, asymmetry double, fa_balanced double, rankfail double, nongrounded double, held_out boolean, degenerate boolean"
SOURCE_AUDIO = "ref string, common_constituent_gain double"
SUBST_DESIGN = "rid string, substitute_ref string, rms_scale double"
