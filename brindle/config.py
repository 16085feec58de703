"""Settings whose values are part of the results; a bad combination is refused when the object is made."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    # Fixed values.
    similarity_threshold: float = 0.75
    intra_paper_ceiling: float = 0.85
    intra_paper_delta: float = 0.20
    hybrid_dense_weight: float = 0.7
    hybrid_sparse_weight: float = 0.3
    hybrid_rrf_k: int = 30
    hybrid_dense_pool: int = 200
    hybrid_sparse_pool: int = 100
    intra_paper_rank_window: int = 30
    max_context_chunks: int = 60
    mention_per_paper_floor: int = 5
    max_resolved_papers: int = 3
    chunk_words: int = 384
    chunk_overlap: int = 48
    history_top_k: int = 5
    embed_batch: int = 96
    snippet_chars: int = 200
    max_attempts: int = 3
    event_queue: int = 2048
    grace_seconds: int = 10
    staging_ttl_seconds: int = 1800
    daily_run_cap: int = 10
    file_bytes_cap: int = 10 * 1024 * 1024
    tree_bytes_cap: int = 25 * 1024 * 1024
    tree_files_cap: int = 2000

    def __post_init__(self) -> None:
        if abs(self.hybrid_dense_weight + self.hybrid_sparse_weight - 1) > 1e-9:
            raise ValueError("the weights of both arms must sum to 1")
        if min(self.hybrid_dense_weight, self.hybrid_sparse_weight) < 0 or self.hybrid_rrf_k < 1:
            raise ValueError("weights must not be negative, and the damping is 1 at least")
        if not 0 < self.similarity_threshold <= self.intra_paper_ceiling <= 2:
            raise ValueError("the gate within one paper must not be tighter than the gate across papers")
        if not 0 <= self.intra_paper_delta <= 2:
            raise ValueError("delta is a distance")
        if min(self.hybrid_dense_pool, self.hybrid_sparse_pool, self.max_context_chunks, self.intra_paper_rank_window) < 1:
            raise ValueError("pools, budget and window are 1 at least")
        if self.hybrid_dense_pool < self.max_context_chunks:
            raise ValueError("a pool below the budget would shrink it")
        if self.mention_per_paper_floor < 0 or self.mention_per_paper_floor > self.max_context_chunks:
            raise ValueError("the floor must fit into the budget")
        if not 0 <= self.chunk_overlap < self.chunk_words:
            raise ValueError("chunks must be longer than their overlap")


CONFIG = EngineConfig()
