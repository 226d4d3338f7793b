"""Spark operators for hourly, multi-site power-forecast tables."""

from galeframe.config import FarmConfig

__all__ = ["FarmConfig"]
