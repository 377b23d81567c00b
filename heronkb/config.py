"""Engine settings: thresholds with their defaults, and the injectable callables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Hooks:
    """External models, as plain functions over lists; each default works offline.

    ``extract(content, path) -> list of page texts``; ``rewrite(texts) -> texts`` is the language model
    that structures pages, ``escalate`` a stronger one for pages where it fails; ``embed(texts) -> vectors``;
    ``rerank(query, texts) -> scores``. A call to a language model is made ``attempts`` times at most, with twice the
    wait each time, and given up after ``timeout_s``; it has ``texts_per_call`` texts at most. ``calls_per_second`` is one budget for all tasks, of
    which ``callers`` call at a time.
    """

    extract: Callable[[bytes, str], list[str]] | None = None
    rewrite: Callable[[Sequence[str]], list[str]] | None = None
    embed: Callable[[Sequence[str]], list[list[float]]] | None = None
    rerank: Callable[[str, Sequence[str]], list[float]] | None = None
    escalate: Callable[[Sequence[str]], list[str]] | None = None
    least_interval_s: float = 0.0
    calls_per_second: float | None = None
    callers: int = 4
    texts_per_call: int = 256
    attempts: int = 1
    retry_wait_s: float = 1.0
    timeout_s: float | None = None


# Defaults that decide results.
@dataclass(frozen=True)
class Settings:
    faithfulness_min: float = 0.85
    max_section_chars: int = 8000
    min_section_chars: int = 40
    max_part_chars: int = 100_000
    structure_min_length_ratio: float = 0.35
    language_sample_chars: int = 4000
    extract_max_pages: int = 200
    chunk_tokens: int = 512
    chunk_overlap: int = 64
    memory_half_life_days: float = 30.0
    memory_working_cap: int = 500
    memory_min_importance: float = 0.05
    memory_scope: str = "shared"
    recall_boost: float = 0.1
    importance_cap: float = 10.0
    graph_min_entity_len: int = 3
    graph_max_entities: int = 30
    job_lease_seconds: int = 90
    job_max_attempts: int = 3
    outbox_max_attempts: int = 5
    pipeline_version: str = "v1"
    target_language: str = "auto"
    rrf_k: int = 60
    overfetch: int = 3
    embed_dim: int = 256
    hooks: Hooks = field(default_factory=Hooks)


DEFAULT = Settings()
# Settings that a workspace may override, by the key in its JSON settings.
OVERRIDABLE = {
    "max_section_chars": "max_section_chars",
    "min_section_chars": "min_section_chars",
    "chunk_tokens": "chunk_tokens",
    "chunk_overlap": "chunk_overlap",
    "max_md_chars": "max_part_chars",
    "faithfulness_min": "faithfulness_min",
    "target_lang": "target_language",
}
