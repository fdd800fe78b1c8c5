"""annalist: a Spark engine for evidence-backed, bitemporal event and claim data."""

__version__ = "0.1.0"
