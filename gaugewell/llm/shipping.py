"""The package for the Python workers of a cluster that does not have it installed."""

from gaugewell.session import ship

__all__ = ["ship"]
