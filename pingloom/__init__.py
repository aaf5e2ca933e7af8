"""pingloom: vehicle-telemetry analytics as Spark DataFrame operators."""

from pingloom.config import Thresholds
from pingloom.session import build_session, pin_session

__all__ = ["Thresholds", "build_session", "pin_session"]
