"""Settings that change results, with their checks."""

from __future__ import annotations

from dataclasses import dataclass


class ConfigError(ValueError):
    """A setting, or a combination of settings, that cannot be used."""


@dataclass(frozen=True)
class RetrievalConfig:
    use_dense: bool = True
    use_lexical: bool = True
    top_k_dense: int = 50
    top_k_lexical: int = 50
    fusion: str = "rrf"
    rrf_k: int = 60
    dense_weight: float = 0.5
    use_rerank: bool = True
    rerank_candidates: int = 20
    final_top_k: int = 5
    expansion: str = "none"
    num_paraphrases: int = 3
    chunk_strategy: str = "recursive_structural"

    def __post_init__(self) -> None:
        if not (self.use_dense or self.use_lexical):
            raise ConfigError("at least one retriever must be on")
        if self.fusion not in ("rrf", "weighted"):
            raise ConfigError(f"unknown fusion {self.fusion!r}")
        if self.expansion not in ("none", "multi_query", "hyde"):
            raise ConfigError(f"unknown expansion {self.expansion!r}")
        if self.use_rerank and self.rerank_candidates < self.final_top_k:
            raise ConfigError("rerank_candidates must be at least final_top_k when reranking")
        if self.rrf_k <= 0:
            raise ConfigError("rrf_k must be positive")
        if self.chunk_strategy not in ("recursive_structural", "fixed_token", "semantic"):
            raise ConfigError(f"unknown chunk strategy {self.chunk_strategy!r}")

    @property
    def label(self) -> str:
        base = "hybrid" if self.use_dense and self.use_lexical else "dense only" if self.use_dense else "lexical only"
        if self.use_dense and self.use_lexical and self.fusion == "weighted":
            base += " (weighted)"
        chunks = {"fixed_token": ", fixed-token chunking", "semantic": ", semantic chunking"}.get(self.chunk_strategy, "")
        return base + (" + rerank" if self.use_rerank else "") + ("" if self.expansion == "none" else f" + {self.expansion}") + chunks

    def with_top_k(self, k: int) -> RetrievalConfig:
        """A request's top_k also raises the shortlist if that is smaller."""
        from dataclasses import replace

        return replace(self, final_top_k=k, rerank_candidates=max(self.rerank_candidates, k))


@dataclass(frozen=True)
class Settings:
    embedding_dim: int = 128
    chunk_size: int = 512
    chunk_overlap: int = 64
    semantic_percentile: float = 95.0
    extractive_sentences: int = 3
    min_sentence_chars: int = 25
    grounding_threshold: float = 0.55
    min_confidence: float = 0.3
    min_sources: int = 1
    cache_size: int = 10_000
    requests_per_minute: int = 60

    def __post_init__(self) -> None:
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ConfigError("chunk_overlap must be less than chunk_size")
