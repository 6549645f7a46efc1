"""Configuration: defaults, a YAML file, one for the environment, environment variables, overrides; later ones win."""

from __future__ import annotations

import copy
import os
import re
from typing import Any

#: Names and defaults of the public configuration file. Fixed values.
DEFAULTS: dict[str, dict[str, Any]] = {
    "general": {"render_dpi": 300, "page_range": None, "output_dir": "./output", "document_context": ""},
    "pdf_detection": {"force_mode": None, "text_quality_threshold": 0.7, "min_text_chars": 20, "formula_font_patterns": ["CMMI", "CMBX", "Cambria Math", "STIXGeneral"]},
    "preprocessing": {"enable_rotation_correction": True, "enable_deskew": True, "deskew_threshold_degrees": 0.5, "enable_inversion_detection": True},
    "layout": {"engine": "doclayout-yolo", "confidence_threshold": 0.5, "merge_adjacent_text": True, "detect_reading_order": True, "detect_columns": True, "discard_types": ["header", "footer", "page_number"]},
    "vlm": {
        "provider": "dashscope", "api_base_url": "", "api_key": "", "model": "qwen3.5-plus", "temperature": 0.1, "max_concurrent": 15, "connection_pool_size": 20, "max_retries": 3, "timeout": 60, "recognition_mode": "full_page", "vlm_downsample_ratio": 0.7,
        "batch_regions": True, "max_regions_per_batch": 5, "max_region_distance": 500, "complexity_threshold": 15, "enable_output_validation": False, "generate_image_alt": True, "custom_prompts": {}, "document_context": "",
    },
    "image_extraction": {"format": "png", "quality": 95, "min_size": 50, "padding": 5, "save_table_images": True, "prefer_embedded": True},
    "render": {"render_dpi": 300, "image_format": "png", "max_page_height_px": 4000, "split_height": 3200, "split_overlap": 200},
    "cache": {"enable": True, "directory": "./cache", "layout_cache_ttl_hours": 24, "vlm_cache_ttl_days": 7, "document_cache_ttl_days": 30, "max_size_mb": 500, "eviction_policy": "lru"},
    "markdown": {"page_separator": "\n\n---\n\n", "include_page_markers": True, "include_source_markers": True, "image_ref_style": "relative", "title_level_strategy": "auto", "discard_header_footer": True},
    "cost_control": {"enable_cost_estimation": True, "budget_limit_yuan": None},
    "api": {"host": "0.0.0.0", "port": 34045, "max_file_size_mb": 100, "max_pages": 200, "async_threshold_pages": 10, "task_ttl_hours": 24},
    "memory": {"max_cached_pages": 3},
    "native_extract": {"fallback_to_vlm": True, "formula_font_patterns": ["CMMI", "CMBX", "Cambria Math"], "garbled_text_threshold": 0.05},
    "video": {"stt_model": "sensevoice-v1", "audio_format": "mp3", "audio_chunk_seconds": 600, "max_key_frames": 20, "frame_interval_seconds": 30},
}

#: Environment variables and where they go.
VARIABLES = {"FOLIATE_API_KEY": ("vlm", "api_key"), "FOLIATE_BASE_URL": ("vlm", "api_base_url"), "FOLIATE_MODEL": ("vlm", "model")}

#: Keys that are accepted and have no influence on any plan.
WITHOUT_EFFECT = {
    ("general", "render_dpi"), ("general", "page_range"), ("general", "document_context"), ("vlm", "provider"), ("vlm", "connection_pool_size"), ("vlm", "recognition_mode"), ("vlm", "generate_image_alt"), ("image_extraction", "quality"),
    ("image_extraction", "prefer_embedded"), ("image_extraction", "save_table_images"), ("render", "image_format"), ("cache", "enable"), ("cache", "directory"), ("cache", "max_size_mb"), ("cache", "eviction_policy"), ("markdown", "image_ref_style"),
    ("cost_control", "enable_cost_estimation"), ("api", "host"), ("api", "port"), ("api", "task_ttl_hours"), ("memory", "max_cached_pages"), ("native_extract", "fallback_to_vlm"), ("video", "stt_model"), ("video", "audio_format"),
}


def merge(base: dict, over: dict) -> dict:
    """base with over laid on it; only mappings on both sides merge."""
    out = copy.deepcopy(base)
    for key, value in over.items():
        out[key] = merge(out[key], value) if isinstance(out.get(key), dict) and isinstance(value, dict) else copy.deepcopy(value)
    return out


def resolve(data: Any) -> Any:
    """data with each string that is ${NAME} and nothing else replaced by the variable, empty if unset."""
    if isinstance(data, dict):
        return {k: resolve(v) for k, v in data.items()}
    if isinstance(data, list):
        return [resolve(v) for v in data]
    found = re.fullmatch(r"\$\{(.*)\}", data, re.S) if isinstance(data, str) else None
    return os.environ.get(found[1], "") if found else data


def read_yaml(path: str) -> dict:
    import yaml

    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as file:
        made = yaml.safe_load(file)
    return made if isinstance(made, dict) else {}


def load(path: str = "./config.yaml", overrides: dict | None = None) -> dict:
    stem, dot, end = path.rpartition(".")
    data = read_yaml(path)
    if env := os.environ.get("FOLIATE_ENV"):
        data = merge(data, read_yaml(f"{stem}.{env}{dot}{end}"))
    data = merge(DEFAULTS, resolve(data))
    for name, (section, key) in VARIABLES.items():
        if name in os.environ:
            data[section][key] = os.environ[name]
    return merge(data, overrides or {})


def validate(data: dict) -> list[str]:
    """What is wrong with a configuration, in words; nothing if all is well."""
    wrong = [f"unknown section {s}" for s in data if s not in DEFAULTS]
    wrong += [f"unknown key {s}.{k}" for s in data if s in DEFAULTS for k in data[s] if k not in DEFAULTS[s]]
    for section, key, low, high in (("layout", "confidence_threshold", 0, 1), ("pdf_detection", "text_quality_threshold", 0, 1), ("vlm", "vlm_downsample_ratio", 0, 1e9)):
        value = data.get(section, {}).get(key, low)
        if not isinstance(value, (int, float)) or not low <= value <= high:
            wrong.append(f"{section}.{key} is {value!r}")
    mode = data.get("pdf_detection", {}).get("force_mode")
    return wrong + ([f"pdf_detection.force_mode is {mode!r}"] if mode not in (None, "scanned", "native", "mixed") else [])


def save(data: dict, path: str) -> None:
    """Writes a configuration as YAML, with the key masked."""
    import yaml

    shown = copy.deepcopy(data)
    if shown.get("vlm", {}).get("api_key"):
        shown["vlm"]["api_key"] = "***"
    with open(path, "w", encoding="utf-8") as file:
        yaml.safe_dump(shown, file, allow_unicode=True, sort_keys=False)
