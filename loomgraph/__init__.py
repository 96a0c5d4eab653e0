"""Code-graph and session-memory analytics as pure DataFrame functions on Spark."""

__version__ = "0.1.0"
