"""Settings with their defaults; a mapping (from YAML, say) overlays one nested level, unknown keys are ignored."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields


@dataclass
class Fusion:
    """Pools, weights and sizes of session selection."""

    top_summaries: int = 15
    top_triples: int = 20
    alpha: float = 0.5
    sessions: int = 15
    prompt_summaries: int = 2
    rrf_k: int = 60
    rrf_weights: tuple[float, float] = (0.6, 0.4)
    rrf_pools: tuple[int, int] = (15, 10)
    linear_weights: tuple[float, float] = (0.7, 0.3)
    linear_pools: tuple[int, int] = (10, 8)


@dataclass
class LocalGraph:
    """Edge weights of local graphs and the seeds and damping of personalised PageRank."""

    synonym_threshold: float = 0.8
    relation_weight: float = 1.0
    synonym_factor: float = 2.0
    context_weight: float = 0.5
    damping: float = 0.8
    anchor_mass: float = 0.2
    session_weight: float = 0.5
    phrase_seeds: int = 5
    decay_exponent: float = 0.2
    beta_ppr: float = 0.8
    beta_semantic: float = 0.2
    max_iterations: int = 100
    tolerance: float = 1e-6
    minmax_epsilon: float = 1e-9


@dataclass
class Extraction:
    """Chunking and entity merging."""

    chunk_size: int = 1200
    chunk_overlap: int = 100
    entity_jaccard: float = 0.85
    multi_relation: bool = False
    weight_by_strength: bool = False
    compat: bool = True


@dataclass
class Config:
    fusion: Fusion = field(default_factory=Fusion)
    graph: LocalGraph = field(default_factory=LocalGraph)
    extraction: Extraction = field(default_factory=Extraction)
    dataset: str = "default"

    @classmethod
    def parse(cls, values: Mapping, dataset: str | None = None) -> Config:
        out = cls()
        for section in fields(out):
            own, part = values.get(section.name), getattr(out, section.name)
            if isinstance(own, Mapping):
                for f in fields(part):
                    if f.name in own:
                        setattr(part, f.name, own[f.name])
            elif own is not None and not hasattr(part, "__dataclass_fields__"):
                setattr(out, section.name, own)
        if dataset:
            out.dataset = dataset
        return out

    @classmethod
    def read(cls, path: str, dataset: str | None = None) -> Config:
        try:
            import yaml
        except ImportError:  # YAML's JSON subset still reads
            import json as yaml

            yaml.safe_load = yaml.load
        with open(path) as file:
            return cls.parse(yaml.safe_load(file) or {}, dataset)

    def to_dict(self) -> dict:
        return asdict(self)
