"""Content fingerprints, exact duplicate analysis and keyed snapshots on Spark."""

__version__ = "0.1.0"
