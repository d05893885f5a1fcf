"""Settings of retrieval, text recovery and evaluation."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace

DATASETS = ("2wiki", "hotpotqa", "musique")
SENTENCE_DATASETS = ("2wiki", "hotpotqa")


@dataclass(frozen=True)
class Settings:
    """Every knob; unknown names are errors.

    ``top_k_entity``: names per surface form; ``relation_k``: candidates kept by relation;
    ``top_n``: candidates kept by the reranker, and bound values tried per variable;
    ``neff_threshold``: largest effective number that counts as resolved; ``strict_recall``: count questions
    without predictions as misses.
    """

    dataset: str = "musique"
    num_samples: int | None = 1000
    top_n: int = 3
    top_k_entity: int = 3
    relation_k: int = 8
    neff_threshold: float = 1.5
    rerank_max_length: int = 128
    rerank_batch: int = 32
    include_question_in_rerank: bool = True
    max_variants_in_text: int = 3
    topk_resolved: int = 3
    topk_unresolved: int = 3
    doc_prefilter_k: int = 80
    unres_top_similar: int = 20
    max_binding_names: int = 5
    recall_ks: tuple[int, ...] = (2, 5, 10)
    strict_recall: bool = False
    prompt_max_texts: int = 3
    chunk_chars: int = 1200
    id_keys: tuple[str, ...] = ("id", "_id", "qid")

    def __post_init__(self):
        if self.dataset not in DATASETS:
            raise ValueError(f"dataset is one of {DATASETS}")

    @property
    def by_sentence(self) -> bool:
        return self.dataset in SENTENCE_DATASETS

    def with_(self, **changes) -> Settings:
        return replace(self, **changes)


def parse_recall_ks(text: str | None) -> tuple[int, ...]:
    """Integers of a comma list; others are dropped, and an empty list is (2, 5, 10)."""
    out = []
    for part in str(text or "").split(","):
        try:
            out.append(int(part.strip()))
        except ValueError:
            continue
    return tuple(out) or (2, 5, 10)


def from_mapping(values: dict) -> Settings:
    """Settings from a flat mapping, such as a parsed JSON or YAML file."""
    known = {f.name: f for f in fields(Settings)}
    if bad := sorted(set(values) - set(known)):
        raise ValueError(f"unknown settings: {bad}")
    got = dict(values)
    if isinstance(got.get("recall_ks"), str):
        got["recall_ks"] = parse_recall_ks(got["recall_ks"])
    if isinstance(got.get("num_samples"), str):
        got["num_samples"] = None if got["num_samples"].strip().lower() in ("none", "null") else int(got["num_samples"])
    return Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in got.items()})


def load_config(path: str) -> Settings:
    """Settings from a JSON file, or a YAML file where a YAML reader is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        import yaml

        return from_mapping(yaml.safe_load(text) or {})
    return from_mapping(json.loads(text))
