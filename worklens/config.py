"""Thresholds and weights, in one place; pass a changed copy to the operators to use others."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """They decide which links and risk points the engine gives."""

    tier1_score: float = 88
    tier2_score: float = 78
    tier1_margin: float = 8
    tier2_margin: float = 4
    candidates: int = 10
    date_window: int = 900
    early_days: int = -30
    tier1_description: float = 90
    tier2_description: float = 78
    strong_context: float = 97
    block_limit: int = 1200
    rare_tokens: int = 8
    pool_limit: int = 1200
    fallback_pool: int = 300
    similarity_cutoff: float = 55
    amount_gate: float = 50
    penalty_ida: float = 14
    penalty_category: float = 10
    penalty_entity: float = 8
    penalty_anchors: float = 6
    high_risk: float = 70
    medium_risk: float = 45
    peer_group: int = 15
    mismatch_min_abs: float = 500_000
    mismatch_min_pct: float = 25
    vendor_flag_pct: float = 35
    vendor_high_pct: float = 60
    reconciliation_pct: float = 10
    seed: int = 42


DEFAULT = Config()
