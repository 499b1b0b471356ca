"""Run configuration: typed sections, unknown keys refused, one hash."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, is_dataclass

from tessera.sources.manifest import object_hash


@dataclass(frozen=True)
class Data:
    seed: int = 20260901
    clients: int = 5
    alpha: float = 0.5
    fit_ratio: float = 0.8
    min_support: int = 5
    holdout: float = 0.1
    min_validation_per_subject: int = 10


@dataclass(frozen=True)
class Retrieval:
    top_k: int = 5
    pools: tuple[int, ...] = (50, 100)
    lexical: tuple[int, int] = (17, 20)
    semantic: float = 0.92
    alpha: float = 1.0
    beta: float = 0.15
    gamma: float = 0.2


@dataclass(frozen=True)
class Evaluation:
    seeds: tuple[int, ...] = (42, 43, 44)
    threshold: float = 0.82
    margin: float = 0.05
    samples: int = 10_000
    confidence: float = 0.95
    max_tokens: int = 4096
    new_tokens: int = 64


@dataclass(frozen=True)
class Config:
    data: Data = field(default_factory=Data)
    retrieval: Retrieval = field(default_factory=Retrieval)
    evaluation: Evaluation = field(default_factory=Evaluation)

    @classmethod
    def of(cls, values: dict) -> Config:
        return _build(cls, values)

    @classmethod
    def read(cls, path: str) -> Config:
        """JSON, or YAML where the library is installed."""
        import json

        with open(path, encoding="utf-8") as source:
            text = source.read()
        if path.endswith((".yaml", ".yml")):
            import yaml

            return cls.of(yaml.safe_load(text) or {})
        return cls.of(json.loads(text))

    def hash(self) -> str:
        return object_hash(asdict(self))

    def check(self) -> None:
        """Raise on the first value outside its range."""
        d, r, e = self.data, self.retrieval, self.evaluation
        rules = {
            "clients must be at least 2": d.clients >= 2,
            "alpha must be positive": d.alpha > 0,
            "fit_ratio must be between 0 and 1": 0 < d.fit_ratio < 1,
            "holdout must be between 0 and 1": 0 < d.holdout < 1,
            "top_k must be positive and within the first pool": 0 < r.top_k <= r.pools[0],
            "pools must grow": list(r.pools) == sorted(set(r.pools)),
            "lexical must be a fraction up to 1": 0 < r.lexical[0] <= r.lexical[1],
            "samples must be positive": e.samples > 0,
            "confidence must be between 0 and 1": 0 < e.confidence < 1,
            "seeds must be distinct": len(set(e.seeds)) == len(e.seeds) > 0,
            "new_tokens must leave room": 0 < e.new_tokens < e.max_tokens,
        }
        broken = [rule for rule, fine in rules.items() if not fine]
        if broken:
            raise ValueError("; ".join(broken))


def _build(kind, values: dict):
    known = {f.name: f for f in fields(kind)}
    unknown = sorted(set(values) - set(known))
    if unknown:
        raise ValueError(f"unknown keys in {kind.__name__}: {unknown}")
    made = {}
    for name, value in values.items():
        default = known[name].default_factory() if callable(known[name].default_factory) else known[name].default
        made[name] = _build(type(default), value) if is_dataclass(default) else tuple(value) if isinstance(default, tuple) else value
    return kind(**made)
