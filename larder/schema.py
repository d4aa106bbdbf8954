"""Schemas of the record tables, and the closed sets of their text columns."""

from __future__ import annotations

PLATFORMS = ["instagram", "youtube", "tiktok", "twitter", "reddit", "linkedin", "web"]
#: Extraction tiers from the cheapest to the last resort; the position is the rank.
TIERS = ["client_payload", "yt_dlp", "managed_api", "open_graph", "degraded"]

ENVELOPES = """
    canonical_url string, url_hash string, original_url string, platform string, title string, author string,
    author_url string, caption string, thumbnail_url string, media_url string, media_kind string, duration_s double,
    published_at timestamp, platform_tags array<string>, like_count bigint, view_count bigint, comment_count bigint,
    transcript string, ocr_text string, article_text string, visual_description string, tier string, degraded boolean,
    reprocessable boolean, extractor_note string, extracted_at timestamp, raw string"""
ATTEMPTS = "url_hash string, tier string, ok boolean, skipped boolean, duration_ms bigint, error string, created_at timestamp"
ENRICHMENTS = """
    url_hash string, summary string, description string, details array<string>, tags array<string>, category string,
    content_type string, entities struct<people:array<string>,organizations:array<string>,places:array<string>,products:array<string>>,
    language string, mode string, provider string, model string, source_hash string, prompt_version int,
    input_tokens bigint, output_tokens bigint, cost_usd double, duration_ms bigint, degraded boolean, note string"""
CHUNKS = "url_hash string, ordinal int, kind string, text string"
VECTORS = "url_hash string, ordinal int, model string, dim int, embedding array<float>"
JOBS = "job_id bigint, url string, status string, stage string, error string, note string, created_at timestamp, updated_at timestamp"
