"""Settings of the three retrieval plans; defaults are the documented ones."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class ApproachConfig:
    name: str
    params: dict = field(default_factory=dict)
    candidates_depth: int | None = None


@dataclass(frozen=True)
class Bm25Config:
    k1: float = 0.9
    b: float = 0.4
    topk: int = 1000


@dataclass(frozen=True)
class ClusterConfig:
    doc_model: str = "bm25+rm3"
    k1: float = 1.0
    b: float = 0.8
    rm3: dict = field(default_factory=lambda: {"fb_terms": 10, "fb_docs": 30, "original_weight": 0.5})
    candidates: int = 5000
    content_topk: int = 2000
    window: int = 10
    least: int = 3
    overlap: int = 2
    passage_model: str = "bm25+rm3"
    passage_rm3: dict = field(default_factory=lambda: {"fb_terms": 50, "fb_docs": 10, "original_weight": 0.2})
    #: Passages per document that go into the ranking, by overlap with the query; all, if None.
    per_doc: int | None = None
    passage_k1: float = 0.9
    passage_b: float = 0.4
    passages: int = 200
    threshold: float = 0.2
    cluster_size: int = 5
    alpha: float = 0.5
    normalization: str = "minmax"
    passages_per_doc: int = 3
    rr_k: int = 100
    lambda_min: float = 0.5
    lambda_max: float = 1.0
    rerank_topn: int = 1000
    topk: int = 1000


@dataclass(frozen=True)
class DenseConfig:
    metric: str = "cosine"
    depth: int = 2000
    rerank: bool = False
    rerank_topn: int = 100
    alpha: float = 0.5
    topk: int = 1000


def load_config(path: str) -> ApproachConfig:
    """A JSON object with ``name``, ``params`` and ``candidates_depth``."""
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(data, dict):
        raise ValueError("the configuration must be an object")
    name, params, depth = data.get("name"), data.get("params"), data.get("candidates_depth")
    if not isinstance(name, str) or not name.strip():
        raise ValueError("name must be a non-blank string")
    if params is not None and not isinstance(params, dict):
        raise ValueError("params must be an object")
    if depth is not None and (isinstance(depth, bool) or not isinstance(depth, int)):
        raise ValueError("candidates_depth must be a number")
    return ApproachConfig(name.strip(), params or {}, depth)
