"""Halyard: relational, spatial, full-text and vector analytics as plain Spark plans."""

__version__ = "0.1.0"
