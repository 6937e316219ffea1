"""Settings of the engine; sizes follow what its users know as limits."""

from __future__ import annotations

from dataclasses import dataclass

MASK = "XXXX"


@dataclass(frozen=True)
class EngineConfig:
    max_upload_bytes: int = 10 * 1024 * 1024
    native_document_bytes: int = 3 * 1024 * 1024
    single_pass_chars: int = 150_000
    chunk_chars: int = 700_000
    ttl_seconds: int = 3600
    look_ahead_rows: int = 30
    plan_head_rows: int = 30


DEFAULT = EngineConfig()
