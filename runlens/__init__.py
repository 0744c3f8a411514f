"""runlens: run-log analytics, state folding and payload operators on Spark."""

__version__ = "0.1.0"
