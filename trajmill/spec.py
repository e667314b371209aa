"""Roles of the columns of a trajectory table."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class TrajectorySpec:
    """Which column is the case, the time, a state or an input.

    ``case`` may be None for a table that holds one trajectory. ``order`` names further
    columns that break ties between rows sharing a time, so that every ordered operator has
    one defined answer.
    """

    time: str
    states: tuple[str, ...]
    inputs: tuple[str, ...] = ()
    case: str | None = None
    measurements: tuple[str, ...] = ()
    order: tuple[str, ...] = ()

    def __post_init__(self):
        for field in ("states", "inputs", "measurements", "order"):
            object.__setattr__(self, field, tuple(getattr(self, field)))

    @property
    def keys(self) -> list[str]:
        return [self.case] if self.case else []

    @property
    def values(self) -> list[str]:
        return [*self.states, *self.inputs]

    @property
    def required(self) -> list[str]:
        return list(dict.fromkeys([*self.keys, self.time, *self.values]))

    @property
    def sort(self) -> list[str]:
        return [self.time, *self.order]

    def with_states(self, states) -> "TrajectorySpec":
        return replace(self, states=tuple(states))

    def project(self, df: DataFrame) -> DataFrame:
        """The role columns only, with time, states and inputs as doubles."""
        numeric = {self.time, *self.values}
        names = list(dict.fromkeys([*self.required, *self.order]))
        return df.select(*[F.col(c).cast("double").alias(c) if c in numeric else F.col(c) for c in names])
