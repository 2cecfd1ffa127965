"""Parameter search: trials are rows, and each runs on its own."""

from __future__ import annotations

from itertools import islice, product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .params import Spec

_MASK = (1 << 64) - 1


class Random:
    """xorshift64* from a seed."""

    def __init__(self, seed: int):
        # The seed's multiplier, the shifts and the output's multiplier of this generator.
        self.state = (seed * 0x9E3779B97F4A7C15) & _MASK or 0x9E3779B97F4A7C15

    def next(self) -> int:
        x = self.state
        x ^= x >> 12
        x = (x ^ (x << 25)) & _MASK
        self.state = x ^ (x >> 27)
        return (self.state * 0x2545F4914F6CDD1D) & _MASK

    def below(self, n: int) -> int:
        return self.next() % n

    def unit(self) -> float:
        return (self.next() >> 11) / (1 << 53)


def space(specs: dict[str, Spec], pinned: dict[str, object]) -> dict[str, object]:
    """Searchable parameters by ``stage.name``, without fixed and pinned ones."""
    return {f"{s}.{n}": p for s, spec in specs.items() for n, p in spec.params.items() if not p.fixed and f"{s}.{n}" not in pinned}


def grid(axes: dict[str, object], cap: int) -> list[dict]:
    """The first ``cap`` points of the product of all axes, the last axis fastest."""
    names = [*axes]
    return [dict(zip(names, v, strict=True)) for v in islice(product(*(axes[n].axis() for n in names)), cap)]


def random_points(axes: dict[str, object], n: int, seed: int) -> list[dict]:
    draw, out = Random(seed), []
    for _ in range(n):
        point = {}
        for name, p in axes.items():
            if p.options or p.step:
                values = p.axis()
                point[name] = values[draw.below(len(values))]
            else:
                point[name] = p.low + draw.unit() * (p.high - p.low)
        out.append(point)
    return out


def trials(spark: SparkSession, points: list[dict]) -> DataFrame:
    """A row for each point: trial_id and the parameters."""
    names = [*points[0]]
    rows = [(f"t{i:06d}", *(p[n] for n in names)) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, ["trial_id", *(n.replace(".", "_") for n in names)])


def best(scored: DataFrame, score: str = "score") -> DataFrame:
    """The trial with the largest finite score, the last of equal ones; the first trial if none is finite."""
    finite = F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    rows = F.struct(*scored.columns)
    first, top = F.min_by(rows, "trial_id"), F.max_by(rows, F.when(finite, F.struct(score, "trial_id")))
    return scored.agg(F.coalesce(top, first).alias("b")).select("b.*")
