"""Strict configurations: every key must be there, none beside them, each in its range; there are no defaults in code."""

from __future__ import annotations

import dataclasses
import json
import types
import typing
from pathlib import Path


class ConfigError(ValueError):
    pass


@dataclasses.dataclass(frozen=True)
class IndexConfig:
    kind: str
    m: int
    build_effort: int
    seeds: list[int]
    cells: int

    def check(self) -> None:
        _rule(self.kind in ("ivf", "graph"), "index.kind")
        _rule(self.m >= 2 and self.build_effort >= 1 and self.cells >= 1 and len(set(self.seeds)) == len(self.seeds) > 0, "index")


@dataclasses.dataclass(frozen=True)
class SweepConfig:
    k: int
    least: int
    most: int
    ratio: float
    target: float

    def check(self) -> None:
        _rule(1 <= self.k <= self.least <= self.most and self.ratio > 1 and 0 < self.target <= 1, "sweep")


@dataclasses.dataclass(frozen=True)
class SplitConfig:
    tests: int
    seed: int

    def check(self) -> None:
        _rule(self.tests > 0 and self.seed >= 0, "split")


@dataclasses.dataclass(frozen=True)
class StudyConfig:
    name: str
    data: str
    index: IndexConfig
    sweep: SweepConfig
    split: SplitConfig
    states: list[str]

    def check(self) -> None:
        _rule(bool(self.name) and bool(self.data) and bool(self.states) and self.states[0] == "S0", "study")


def _rule(ok: bool, what: str) -> None:
    if not ok:
        raise ConfigError(f"{what} is out of range")


def _build(cls, given, at: str):
    if not isinstance(given, dict):
        raise ConfigError(f"{at or 'the configuration'} is not a mapping")
    kinds = typing.get_type_hints(cls)
    if missing := sorted(set(kinds) - set(given)):
        raise ConfigError(f"missing: {', '.join(at + m for m in missing)}")
    if extra := sorted(set(given) - set(kinds)):
        raise ConfigError(f"unknown: {', '.join(at + e for e in extra)}")
    values = {}
    for name, kind in kinds.items():
        v = given[name]
        if dataclasses.is_dataclass(kind):
            v = _build(kind, v, f"{at}{name}.")
        elif isinstance(kind, types.GenericAlias):
            inner = typing.get_args(kind)[0]
            if not isinstance(v, list) or not all(type(x) is inner for x in v):
                raise ConfigError(f"{at}{name} is not a list of {inner.__name__}")
        elif kind is float and type(v) is int:
            v = float(v)
        elif type(v) is not kind:
            raise ConfigError(f"{at}{name} is not of type {kind.__name__}")
        values[name] = v
    out = cls(**values)
    out.check()
    return out


def parse(given: dict) -> StudyConfig:
    return _build(StudyConfig, given, "")


def load(path: str) -> StudyConfig:
    """From JSON, or from YAML where its parser is installed."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        import yaml

        return parse(yaml.safe_load(text))
    return parse(json.loads(text))


def cells(config: StudyConfig) -> list[tuple[int, str]]:
    """Every (seed, state) of a study."""
    return [(s, t) for s in config.index.seeds for t in config.states]
