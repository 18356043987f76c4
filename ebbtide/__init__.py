"""Customer-attrition analytics on Spark: windowed features, labels, scenarios, models and reports."""

from ebbtide.session import build_session

__all__ = ["build_session"]
