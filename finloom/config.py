"""Settings of the pipelines."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class ChunkConfig:
    """Tokens of a packed chunk (target), the least it should have, the window's size and the overlap's share."""

    target_tokens: int = 600
    min_tokens: int = 200
    max_tokens: int = 800
    overlap_ratio: float = 0.15

    @property
    def step(self) -> int:
        return max(1, int(self.max_tokens * (1 - self.overlap_ratio)))

    @classmethod
    def load(cls, path: str) -> ChunkConfig:
        """From a YAML file whose keys (at any depth) are the fields' names; others are ignored."""
        import yaml

        found: dict = {}

        def walk(node):
            if isinstance(node, dict):
                for k, v in node.items():
                    walk(v) if isinstance(v, dict) else found.setdefault(k, v)

        with open(path) as f:
            walk(yaml.safe_load(f))
        return cls(**{f.name: found[f.name] for f in fields(cls) if f.name in found})


@dataclass(frozen=True)
class SearchConfig:
    """Rank constant, weights of the legs, over-fetch and its bound, and the pool that is reranked."""

    rrf_k: int = 60
    lexical_weight: float = 0.5
    dense_weight: float = 0.5
    overfetch: int = 3
    max_fetch: int = 100
    pool: int = 20

    def weights(self) -> tuple[float, float]:
        total = self.lexical_weight + self.dense_weight
        return self.lexical_weight / total, self.dense_weight / total

    def fetch(self, k: int) -> int:
        """Rows of a leg for k results: the bounded over-fetch, never less than k."""
        return max(k, min(self.overfetch * k, self.max_fetch))
