"""How scores combine: aggregates by name, and a registry for more."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

COMBINERS: dict[str, Callable[[Column], Column]] = {}


def combiner(name: str):
    def register(build: Callable[[Column], Column]) -> Callable[[Column], Column]:
        if name in COMBINERS:
            raise ValueError(f"combiner {name!r} exists")
        COMBINERS[name] = build
        return build

    return register


def combine(name: str, score: Column) -> Column:
    if name not in COMBINERS:
        raise KeyError(f"no combiner {name!r}; there are {sorted(COMBINERS)}")
    return COMBINERS[name](score)


@combiner("max")
def _max(score: Column) -> Column:
    return F.coalesce(F.max(score), F.lit(0.0))


@combiner("sum")
def _sum(score: Column) -> Column:
    return F.coalesce(F.sum(score), F.lit(0.0))


@combiner("noisy_or")
def noisy_or(score: Column) -> Column:
    """One minus the chance that every signal is wrong."""
    inside = F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0))
    return F.coalesce(1 - F.product(1 - inside), F.lit(0.0))
