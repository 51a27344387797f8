"""Settings that parameterise the operators, and how a collection's override a user's."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one query that a ranking is scanned to, at most.
MAX_SCAN = 200
#: How much deeper than the limit each kind of answer scans.
DEEPER = {"chunk": 2, "passage": 4, "section": 20}


@dataclass(frozen=True)
class SearchSettings:
    limit: int = 25
    candidates: int = 50
    mode: str = "hybrid"
    fusion: str = "rrf"
    rrf_k: int = 60
    vector_weight: float = 0.7
    bm25_weight: float = 0.3
    nprobes: int = 20
    refine_factor: int = 10
    reranker: str = "none"
    score_fold: str = "sum"
    fill_values: str = "relative"
    min_rerank_score: float | None = None
    min_passage_chars: int = 300
    max_passage_grow: int = 3
    grow_bias: float = 0.0
    max_section_chars: int = 12_000
    answer_budget_chars: int = 44_000

    def __post_init__(self) -> None:
        if self.mode not in ("vector", "bm25", "hybrid") or self.fusion not in ("rrf", "linear") or self.score_fold not in ("sum", "max", "harmonic"):
            raise ValueError(f"unknown mode, fusion or fold: {self.mode}, {self.fusion}, {self.score_fold}")

    @property
    def vector_share(self) -> float:
        whole = self.vector_weight + self.bm25_weight
        return self.vector_weight / whole if whole else 0.5

    def scan(self, kind: str) -> tuple[int, int]:
        """(rows that are kept of a ranking, rows that each half reads) for an answer of a kind."""
        scan = max(self.limit, min(self.limit * DEEPER[kind], MAX_SCAN))
        return scan, max(self.candidates, scan)


@dataclass(frozen=True)
class ChunkSettings:
    chunker: str = "markdown"
    chunk_size: int = 1200
    merge_below: int = 66
    frame: bool = True


FIELDS = ["mode", "fusion", "rrf_k", "vector_weight", "bm25_weight", "nprobes", "refine_factor", "reranker", "min_rerank_score"]


def resolved(settings: DataFrame) -> DataFrame:
    """Each collection's settings: a null field inherits the user's, which are the row without a collection."""
    user = settings.where("collection is null").agg(*(F.max(f).alias(f"user_{f}") for f in FIELDS))
    own = settings.where("collection is not null").crossJoin(F.broadcast(user))
    return own.select("collection", *(F.coalesce(f, f"user_{f}").alias(f) for f in FIELDS))


def vector_share(vector: Column, bm25: Column) -> Column:
    """The vector half's share of a linear fusion; one half where both weights are 0."""
    return F.when(vector + bm25 > 0, vector / (vector + bm25)).otherwise(0.5)
