"""Postura: body-posture and workload analytics as Spark DataFrame operators."""

from postura.config import Thresholds

__all__ = ["Thresholds"]
