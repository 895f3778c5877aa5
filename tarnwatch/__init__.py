"""Data quality, drift and delayed-label evaluation of model data on Spark."""

from tarnwatch.config import (
    AlertPolicy,
    CalibrationPolicy,
    DriftPolicy,
    ExportPolicy,
    GatePolicy,
    LabelPolicy,
    StorePolicy,
)
from tarnwatch.session import build_session

__all__ = [
    "AlertPolicy",
    "CalibrationPolicy",
    "DriftPolicy",
    "ExportPolicy",
    "GatePolicy",
    "LabelPolicy",
    "StorePolicy",
    "build_session",
]
