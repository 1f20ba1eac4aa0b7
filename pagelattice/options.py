"""Options of a graph build and the two dialects."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Options:
    dialect: str = "batch"
    no_crawl: bool = False
    refresh: bool = False
    max_chars: int = 6000
    embed_max_chars: int = 2000
    excerpt_chars: int = 400
    live_chars: int = 5000
    embed_model: str = "nomic-embed-text"
    store_embeddings: bool = False
    edge_threshold: float = 0.2
    group_threshold: float = 0.25
    domain_bonus: float = 0.25
    domain_group: bool = True
    domain_group_min: int = 2
    knn_k: int = 6
    mutual_knn: bool = True
    index: tuple[int, int] | None = None  # (cells, probes) of the vector index for neighbours; None compares all vectors
    dedupe_hamming: int = 3
    keyword_count: int = 8
    summary_sentences: int = 3
    label_share: float = 0.55
    extra_stopwords: tuple[str, ...] = field(default=())

    @property
    def domain_group_least(self) -> int:
        """The batch dialect never groups a domain of one tab."""
        return max(2, self.domain_group_min) if self.dialect == "batch" else self.domain_group_min

    def fingerprint(self) -> str:
        """What a cache entry depends on, so that entries of other options aren't reused."""
        return f"{self.dialect}/{int(self.no_crawl)}/{self.keyword_count}/{self.max_chars}/{self.embed_model}"


BATCH, LIVE = Options(), replace(Options(), dialect="live")
