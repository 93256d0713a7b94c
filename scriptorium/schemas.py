"""Fixed schemas: nothing is inferred from the first rows."""

from __future__ import annotations

ASSET = "struct<name:string,media_type:string,payload_bytes:binary,text_payload:string,local_path:string>"

MANIFEST = ("sample_id string, source_id string, bundle_id string, doc_id string, page_id string, data_class string, task_family string, target_type string, canonical_target string, "
    "canonical_target_hash string, difficulty_tier string, slice_tags array<string>, split_assignment string, transform_recipe string, source_license string, target_char_count int, "
    "has_display_math boolean, has_inline_math boolean, has_gfm_table boolean, has_table_block boolean, has_figure_caption boolean, has_heading boolean, has_list boolean, "
    "asset_names array<string>, asset_media_types array<string>, metadata_json string"
)

MANUAL = ("sample_id string, doc_id string, page_id string, data_class string, task_family string, target_type string, canonical_target string, split_assignment string, "
    "difficulty_tier string, slice_tags array<string>, asset_paths array<string>, source_license string, metadata map<string,string>"
)

FAILURES = "source_bundle_id string, source_sample_id string, corrupted_prediction string, target_block string, failure_type string, difficulty_tier string, failure_score double"

EVENTS = "ts timestamp, event_type string, phase string, stage string, payload string"

PAGE = "page_id string, markdown string, blocks array<struct<type:string,markdown:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,confidence:double>>, warnings array<string>"
BLOCK_TYPES = ("heading", "paragraph", "list", "table", "formula", "figure")

SAMPLE_DEFAULTS = {"data_class": "trusted_aux", "task_family": "document_parsing", "target_type": "aux_annotation", "split_assignment": "train", "difficulty_tier": "medium"}

REGISTRIES = {
    "source-registry": "source_id string, source_name string, data_class string, primary_role string, task_coverage string, target_authority string, license_or_access_status string, ingestion_priority string, retention_mode string, notes string",
    "source-endpoints": "source_id string, probe_policy string, probe_method string, probe_url string, remote_fetchable string, build_surface string, notes string",
    "source-status": "source_id string, approved_role string, current_status string, next_action string, notes string",
    "bundle-registry": "bundle_id string, stage string, bundle_class string, primary_sources string, data_class_mix string, persistent_store string, target_status string, notes string",
    "profile-registry": "profile_id string, focus string, bundles string, source_groups string, use_case string",
    "publish-registry": "artifact_group string, persistent_namespace string, artifact_kind string, required_for_release string, git_companion_required string, verification_rule string, retention_policy string",
    "source-allocation": "bundle_id string, source_id string, target_samples int, role string, notes string",
    "datasets": "dataset_family string, scope string, primary_role string, unit string, public_status string, core_strength string, main_weakness string, default_split_policy string, covered_protocols string",
    "baselines": "baseline_id string, model_name string, `group` string, open_status string, primary_role string, size_band string, main_protocols string, evidence_policy string, notes string",
}
"""Pipe lists and yes/no columns are strings here; ``sources.registry`` splits and casts them."""


def columns_of(ddl: str) -> list[tuple[str, str]]:
    """The (name, type) pairs of a flat schema string."""
    return [tuple(part.strip().split(" ", 1)) for part in ddl.split(", ")]
