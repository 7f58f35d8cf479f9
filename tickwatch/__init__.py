"""tickwatch: market anomaly analytics as Spark dataflows (batch and stream)."""

__version__ = "0.1.0"
