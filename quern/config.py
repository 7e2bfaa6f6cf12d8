"""Tuning constants of retrieval, ranking, chunking and evaluation."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Tuning:
    w_text: float = 0.5
    w_usage: float = 0.3
    w_recency: float = 0.1
    w_path: float = 0.1
    name_contains: float = 0.85
    description_contains: float = 0.65
    weak_text: float = 0.2
    overlap_tiers: tuple[tuple[int, float, float], ...] = ((4, 0.45, 0.78), (3, 0.30, 0.68), (2, 0.18, 0.56))
    usage_log_divisor: float = 3.0
    recency_tiers: tuple[tuple[int, float], ...] = ((7, 1.0), (30, 0.8), (90, 0.6), (180, 0.4))
    recency_oldest: float = 0.25
    recency_default: float = 0.4
    path_yes: float = 1.0
    path_no: float = 0.35
    callee_per_match: float = 0.05
    callee_max: float = 0.2
    semantic_high: float = 0.55
    semantic_medium: float = 0.40
    usage_high: float = 0.6
    literal_boost: float = 0.22
    index_boost: float = 0.18
    demo_penalty: float = 0.18
    sibling_penalty: float = 0.25
    final_threshold: float = 0.45
    rrf_k: int = 60
    search_cap: int = 20
    target_chars: int = 900
    max_chars: int = 1200
    overlap_chars: int = 120
    sentence_ratio: float = 0.6
    summary_chars: int = 160
    context_chars: int = 6000
    context_chunks: int = 12
    adjacent_radius: int = 1
    category_floor: float = 0.5
    main_k: int = 10
    wide_k: int = 50
    # Flags for behaviour that differs from the default pipeline's.
    rrf_as_similarity: bool = True
    reusable_filter: bool = False
    quality_gate: bool = False
    split_camel: bool = False
    structure_prefetch: bool = True
    field_weights: tuple[float, float, float, float] = (1.0, 0.4, 0.2, 0.1)


DEFAULT = Tuning()
