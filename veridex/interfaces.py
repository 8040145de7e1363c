"""What a retriever and a reranker of one's own must offer to take part in the chain."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Status:
    """What was asked for, what was used, and why they differ."""

    requested: str
    actual: str
    degraded: bool = False
    reason: str = ""


class Retriever(Protocol):
    def search(self, specs: DataFrame, top_k: int) -> tuple[DataFrame, Status]:
        """(q, id, rank, score) for the questions of query specifications."""


class Reranker(Protocol):
    def rerank(self, entries: DataFrame, top_k: int) -> tuple[DataFrame, Status]:
        """(q, id, rank, score) of entries (q, id, score, ...)."""


class Encoder(Protocol):
    def encode(self, texts: DataFrame) -> DataFrame:
        """(id, vec) of (id, text), by an Arrow-batched function."""
