"""Constants that decide results; each is a parameter of the operator that uses it."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Built-in kinds of notes, weights of edge types (others weigh 1), sizes and weights of ranking.
KINDS = ["spec", "decision", "runbook", "report", "reference", "incident", "experiment", "dataset", "skill", "memory", "note", "journal"]
EDGE_WEIGHTS = {"references": 1.0, "depends-on": 2.0, "supersedes": 1.5, "contradicts": 1.5, "extends": 1.2, "informed-by": 0.8}
FIELD_WEIGHTS = {"title": 5.0, "body": 1.0, "spine": 2.0, "aliases": 3.0, "keywords": 10.0}


@dataclass(frozen=True)
class Ranking:
    threshold: float = 0.10
    top_k: int = 100
    limit: int = 10
    cosine: float = 0.50
    graph: float = 0.25
    engagement: float = 0.25
    half_life_hours: float = 168.0
    saturation: float = 20.0
    recency: float = 0.60
    popularity: float = 0.40
    decay: float = 0.5
    respect_domain: bool = False
    fields: dict = field(default_factory=lambda: dict(FIELD_WEIGHTS))
