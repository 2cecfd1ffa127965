"""Parameters: what a stage takes, whether values are right, and what can be searched."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import isfinite


@dataclass(frozen=True)
class Param:
    """A whole number, a number or a choice, with bounds and steps; a fixed one is not searched."""

    name: str
    default: int | float | str
    low: float | None = None
    high: float | None = None
    step: float | None = None
    options: tuple[str, ...] = ()
    fixed: bool = False

    def parse(self, text: str) -> int | float | str:
        if isinstance(self.default, str):
            return text
        try:
            return int(text) if isinstance(self.default, int) else float(text)
        except ValueError:
            raise ValueError(f"{self.name}: {text!r} is not a number") from None

    def check(self, value):
        if isinstance(self.default, str):
            if self.options and value not in self.options:
                raise ValueError(f"{self.name}: {value!r}; valid options: {', '.join(self.options)}")
            return value
        if isinstance(value, str) or not isfinite(value):
            raise ValueError(f"{self.name}: {value!r} is not a finite number")
        if self.low is not None and not self.low <= value <= self.high:
            raise ValueError(f"{self.name}: {value} is not in [{self.low}, {self.high}]")
        if isinstance(self.default, int) and self.step and (value - self.low) % self.step:
            raise ValueError(f"{self.name}: {value} is not a step of {self.step} from {self.low}")
        return value

    def axis(self, points: int = 5) -> list:
        """Values of a grid: all options, all steps, or a number of points."""
        if self.options:
            return [*self.options]
        if self.low is None:
            return [self.default]
        if self.step:
            count = int((self.high - self.low) / self.step + 1e-9) + 1
            return [type(self.default)(self.low + i * self.step) for i in range(count)]
        return [self.low + (self.high - self.low) * i / (points - 1) for i in range(points)]


class Spec:
    """The parameters of one stage."""

    def __init__(self, *params: Param):
        self.params = {p.name: p for p in params}

    def parse(self, pairs: list[str]) -> dict:
        """Values of ``name=value`` texts."""
        out: dict = {}
        for pair in pairs:
            name, eq, text = pair.partition("=")
            if not eq or not name or not text:
                raise ValueError(f"{pair!r} is not name=value")
            if name in out:
                raise ValueError(f"{name} is given twice")
            out[name] = self[name].parse(text)
        return self.resolve(out) and out

    def __getitem__(self, name: str) -> Param:
        if name not in self.params:
            raise ValueError(f"unknown parameter {name}; known: {', '.join(self.params)}")
        return self.params[name]

    def resolve(self, given: dict) -> dict:
        """All values: those given, checked, and the defaults."""
        return {n: p.default for n, p in self.params.items()} | {n: self[n].check(v) for n, v in given.items()}


class Registry:
    """Builders by kind of stage and name."""

    KINDS = ("source", "aggregator", "indicator", "strategy")

    def __init__(self):
        self.stages: dict[tuple[str, str], tuple[Callable, Spec]] = {}

    def add(self, kind: str, name: str, build: Callable, spec: Spec) -> None:
        if kind not in self.KINDS:
            raise ValueError(f"unknown kind {kind}")
        self.stages[kind, name] = build, spec

    def names(self, kind: str) -> list[str]:
        return sorted(n for k, n in self.stages if k == kind)

    def spec(self, kind: str, name: str) -> Spec:
        if (kind, name) not in self.stages:
            raise ValueError(f"unknown {kind} {name}; known: {', '.join(self.names(kind))}")
        return self.stages[kind, name][1]

    def build(self, kind: str, name: str, **given):
        spec = self.spec(kind, name)
        return self.stages[kind, name][0](**spec.resolve(given))
