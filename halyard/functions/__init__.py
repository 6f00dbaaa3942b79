"""Expression builders. Every builder returns Spark SQL text that Catalyst inlines: no Python runs per row."""

from halyard.functions import scalar, spatial, text, vector

__all__ = ["scalar", "spatial", "text", "vector"]
