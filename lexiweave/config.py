"""Settings of extraction, indexing and graphs; immutable, so options never leak between calls."""

from __future__ import annotations

from dataclasses import dataclass, field

INF = float("inf")


@dataclass(frozen=True)
class SourceFields:
    """Columns of a source by their role. ``label`` falls back to ``label_default`` where the column is absent."""

    id: str = "doc_id"
    content: str = "abstract"
    corpus_id: str = "corp_id"
    label: str = "acronym"
    label_default: str = "doc_id"
    optional: dict[str, str] = field(default_factory=lambda: {"title": "title", "acronym": "acronym", "keywords": "keywords"})


@dataclass(frozen=True)
class Extraction:
    fields: tuple[str, ...] = ("title", "content")
    ngram_min: int = 1
    ngram_max: int = 4
    min_occurrences: int = 1


@dataclass(frozen=True)
class GraphConfig:
    """Thresholds are inclusive at both ends."""

    proximity: str = "cooccurrences"
    node_threshold: tuple[float, float] = (1.0, INF)
    edge_threshold: tuple[float, float] = (0.0001, INF)
    alpha: float = 0.1
    max_degree: int | None = None


NGRAM_GRAPH = GraphConfig()
DOCUMENT_GRAPH = GraphConfig(proximity="log_jaccard", max_degree=100)
