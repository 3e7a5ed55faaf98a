"""Experiment settings from YAML: sections, checks, and suggestions for misspelt keys."""

from __future__ import annotations

import difflib
from dataclasses import dataclass, field, fields, replace
from typing import Any

from vecroute.operators.training import TrainSettings


def _positive(section: str, obj: Any, *names: str) -> None:
    for name in names:
        value = getattr(obj, name)
        if value is not None and value <= 0:
            raise ValueError(f"{section}.{name} must be positive")


@dataclass(frozen=True)
class Model:
    branching_factor: int = 256
    tree_height: int = 2
    embedding_dim: int = 128
    alpha: float = 1.0
    num_trees: int = 4
    #: units of the router's hidden layer, which path and vector share
    ff_dim: int = 1024
    # accepted for the sake of existing files: the router here has one layer, fitted on all pairs at once
    encoder_hidden: int = 1024
    embed_dim: int = 256
    num_decoder_layers: int = 1
    num_heads: int = 8
    dropout: float = 0.1

    def __post_init__(self):
        _positive("model", self, "tree_height", "embedding_dim", "alpha", "num_trees", "ff_dim")
        if self.branching_factor < 2:
            raise ValueError("model.branching_factor must be 2 or more")
        if (self.encoder_hidden, self.num_decoder_layers) != (1024, 1):
            raise ValueError("model.encoder_hidden and model.num_decoder_layers are fixed at 1024 and 1")


@dataclass(frozen=True)
class Training:
    top_k_neighbors: int = 100
    neighbor_search_subset: int = 1_000_000
    query_fraction: float = 0.01
    max_alternating_cycles: int | None = None
    num_epochs: int | None = None
    alternating_interval: int = 2
    convergence_patience: int | None = 2
    convergence_min_delta: float = 0.005
    label_refresh: str = "per_cycle"
    # accepted and without effect: Spark decides on batches and devices
    batch_size: int = 1024
    learning_rate: float = 1e-4
    weight_decay: float = 1e-5
    neighbor_search_mode: str = "random_subset"
    neighbor_search_chunk_size: int = 1_000_000
    neighbor_search_backend: str = "auto"
    tree_update_cache_embeddings: Any = "auto"
    tree_update_batch_size: Any = "auto"
    tree_update_top_r: int | None = None
    device: str = "auto"

    def __post_init__(self):
        _positive("training", self, "top_k_neighbors", "neighbor_search_subset", "query_fraction")
        if self.top_k_neighbors > self.neighbor_search_subset:
            raise ValueError("training.top_k_neighbors exceeds training.neighbor_search_subset")
        if self.alternating_interval != 2:
            raise ValueError("training.alternating_interval is fixed at 2")
        if self.label_refresh not in ("once", "per_cycle"):
            raise ValueError("training.label_refresh must be once or per_cycle")
        if self.cycles() is None and self.convergence_patience is None:
            raise ValueError("unbounded training needs training.convergence_patience")

    def cycles(self) -> int | None:
        if self.max_alternating_cycles is not None:
            return self.max_alternating_cycles
        return None if self.num_epochs is None else -(-self.num_epochs // self.alternating_interval)


@dataclass(frozen=True)
class Dataset:
    name: str
    path: str
    split: str = "train"
    base_path: str | None = None
    query_path: str | None = None
    ground_truth_path: str | None = None
    subset_size: int | None = None
    metric: str | None = None
    normalize: bool = False
    storage_mode: str = "auto"
    source_name: str | None = None
    source_url: str | None = None

    def __post_init__(self):
        for name in ("name", "path", "split"):
            if not getattr(self, name):
                raise ValueError(f"dataset.{name} must not be empty")
        _positive("dataset", self, "subset_size")
        if self.storage_mode not in ("auto", "memmap", "preload"):
            raise ValueError("dataset.storage_mode must be auto, memmap or preload")


@dataclass(frozen=True)
class Evaluation:
    recall_at: list[int] = field(default_factory=lambda: [10])
    num_queries: int = 10_000
    beam_size: int = 100
    num_leaves: list[int] = field(default_factory=lambda: [100])
    min_trees: int | None = None
    rerank_backend: str = "auto"
    performance_profile: bool = False
    search_repetitions: int = 1

    def __post_init__(self):
        _positive("evaluation", self, "num_queries", "beam_size", "search_repetitions")
        if not self.recall_at or min(self.recall_at) <= 0:
            raise ValueError("evaluation.recall_at must hold positive numbers")
        if min(self.num_leaves) <= 0 or max(self.num_leaves) > self.beam_size:
            raise ValueError(f"evaluation.num_leaves must lie in 1..{self.beam_size}")


@dataclass(frozen=True)
class Experiment:
    name: str
    seed: int
    output_dir: str
    tree_assignment_mode: str = "round"
    tree_assignment_order: str = "confidence"

    def __post_init__(self):
        if not self.name or not self.output_dir:
            raise ValueError("experiment.name and experiment.output_dir must not be empty")
        if not isinstance(self.seed, int) or self.seed < 0:
            raise ValueError("experiment.seed must be a whole number, 0 or more")
        if self.tree_assignment_mode not in ("round", "sequential"):
            raise ValueError("experiment.tree_assignment_mode must be round or sequential")
        if self.tree_assignment_order not in ("input", "confidence", "margin"):
            raise ValueError("experiment.tree_assignment_order must be input, confidence or margin")


SECTIONS = {"experiment": Experiment, "dataset": Dataset, "model": Model, "training": Training, "evaluation": Evaluation}


@dataclass(frozen=True)
class Config:
    experiment: Experiment
    dataset: Dataset
    model: Model = field(default_factory=Model)
    training: Training = field(default_factory=Training)
    evaluation: Evaluation = field(default_factory=Evaluation)

    def __post_init__(self):
        m = self.evaluation.min_trees
        if m is not None and not 1 <= m <= self.model.num_trees:
            raise ValueError(f"evaluation.min_trees must lie in 1..{self.model.num_trees}")

    def metric(self) -> str:
        return self.dataset.metric or "euclidean"

    def train_settings(self) -> TrainSettings:
        t = self.training
        return TrainSettings(
            self.model.branching_factor, self.model.tree_height, self.model.alpha, t.top_k_neighbors, t.query_fraction,
            t.neighbor_search_subset, t.cycles() or 0, t.convergence_min_delta, t.convergence_patience, self.metric(),
            self.experiment.tree_assignment_mode, self.experiment.tree_assignment_order, t.label_refresh, self.experiment.seed,
            hidden=self.model.ff_dim,
        )

    def override(self, **values: Any) -> Config:
        """With some settings replaced, named ``section__key``; None leaves one as it is."""
        out = self
        for name, value in values.items():
            if value is not None:
                section, key = name.split("__")
                out = replace(out, **{section: replace(getattr(out, section), **{key: value})})
        return out

    def problems(self) -> list[str]:
        """What a run that is to be kept must not have."""
        m, t, e = self.model, self.training, self.experiment
        top = t.tree_update_top_r
        found = {
            "training.num_epochs is for old files: leave it out, and let convergence end the run": t.num_epochs is not None,
            "model.embed_dim must be a multiple of model.num_heads": m.num_heads < 1 or m.embed_dim % m.num_heads != 0,
            "model.alpha must be 1 or more": m.alpha < 1,
            f"training.neighbor_search_backend must be one of {', '.join(MINING)}": t.neighbor_search_backend not in MINING,
            f"evaluation.rerank_backend must be one of {', '.join(RERANKING)}": self.evaluation.rerank_backend not in RERANKING,
            "training.tree_update_cache_embeddings must be auto, true or false": str(t.tree_update_cache_embeddings).lower() not in ("auto", "true", "false"),
            "training.tree_update_top_r must be 2 or more": top is not None and top < 2,
            "sequential assignment needs all branches: training.tree_update_top_r must reach model.branching_factor": e.tree_assignment_mode == "sequential"
            and top is not None
            and top < m.branching_factor,
        }
        return [text for text, wrong in found.items() if wrong]

    def checked(self, skip: bool = False) -> Config:
        """Itself, or an error that names all ``problems``; with ``skip`` they pass."""
        if not skip and (found := self.problems()):
            raise ValueError("settings aren't fit for a run: " + "; ".join(found))
        return self

    def advice(self) -> list[str]:
        """What is legal but seldom meant."""
        leaves = self.model.branching_factor**self.model.tree_height
        out = []
        if self.evaluation.beam_size > leaves:
            out.append(f"the beam of {self.evaluation.beam_size} exceeds the {leaves} leaves")
        if self.dataset.subset_size and self.dataset.subset_size < leaves:
            out.append(f"{leaves} leaves for {self.dataset.subset_size} vectors: some stay empty")
        if self.training.neighbor_search_backend != "auto" or self.evaluation.rerank_backend != "auto":
            out.append("backends are Spark's; the setting has no effect")
        return out


# Names of backends that settings may hold.
MINING = ("auto", "faiss_cpu", "faiss_gpu")
RERANKING = ("auto", "numpy_cpu", "torch_gpu", "torch_gpu_resident")


def _closest(name: str, known: list[str]) -> str:
    near = difflib.get_close_matches(name, known, 1)
    return f"; did you mean {near[0]!r}?" if near else ""


def from_mapping(raw: dict, strict: bool = True) -> Config:
    if not isinstance(raw, dict):
        raise ValueError("settings must be a mapping of sections")
    parts = {}
    for name in raw:
        if name not in SECTIONS and strict:
            raise ValueError(f"unknown section {name!r}{_closest(name, list(SECTIONS))}")
    for name, kind in SECTIONS.items():
        values = raw.get(name) or {}
        if not isinstance(values, dict):
            raise ValueError(f"section {name!r} must be a mapping")
        known = [f.name for f in fields(kind)]
        for key in values:
            if key not in known and strict:
                raise ValueError(f"unknown key {name}.{key}{_closest(key, known)}")
        parts[name] = kind(**{k: v for k, v in values.items() if k in known})
    return Config(**parts)


def load_config(path: str, strict: bool = True) -> Config:
    import yaml

    with open(path) as f:
        return from_mapping(yaml.safe_load(f), strict)
