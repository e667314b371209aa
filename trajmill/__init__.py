"""Controlled-trajectory analytics as Spark DataFrame operators."""

from trajmill.spec import TrajectorySpec

__all__ = ["TrajectorySpec"]
