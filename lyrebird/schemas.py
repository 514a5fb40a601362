"""Declared schemas of the engine's tables, as DDL."""

from __future__ import annotations

SOURCES = (
    "id long, source_type string, source_id string, title string, description string, url string, channel_name string, "
    "published_at timestamp, duration_s int, view_count long, like_count long, comment_count long, thumbnail_url string, "
    "tags array<string>, provenance string, access_level string, metadata string, created_at timestamp, updated_at timestamp"
)
SEGMENTS = (
    "id string, video_id string, source_id long, start_sec double, end_sec double, speaker_label string, speaker_conf double, text string, "
    "avg_logprob double, compression_ratio double, no_speech_prob double, temperature_used double, re_asr boolean, is_overlap boolean, "
    "needs_refinement boolean, embedding array<float>, created_at timestamp, updated_at timestamp"
)
INGEST_STATE = (
    "video_id string, title string, published_at timestamp, duration_s int, status string, last_error string, retries int, chunk_count int, "
    "embedding_count int, processing_cost decimal(8,4), processing_method string, updated_at timestamp"
)
API_CACHE = "key string, etag string, updated_at timestamp"
SUMMARIES = "cache_key string, query_text string, summary_text string, citations string, clip_ids array<string>, model string, confidence decimal(3,2), expires_at timestamp, created_at timestamp"
DAILY_RUNS = "id long, run_date date, videos_processed int, total_cost decimal(8,4), started_at timestamp, finished_at timestamp, status string"

TABLES = {"sources": SOURCES, "segments": SEGMENTS, "ingest_state": INGEST_STATE, "api_cache": API_CACHE, "summaries": SUMMARIES, "daily_processing_runs": DAILY_RUNS}

# Fixed values of the data model's enumerations.
SOURCE_TYPES = ("youtube", "zoom", "youtube_api", "local_file")
PRIMARY, GUEST, UNKNOWN = "PRIMARY", "GUEST", "Unknown"
STATUSES = ("pending", "has_yt_transcript", "needs_whisper", "transcribed", "chunked", "embedded", "upserted", "error", "skipped", "done")
PROVENANCES = ("owner", "yt_caption", "yt_dlp", "whisper")
