"""Fluvial: Spark-native analytics for sensor rasters, masks, sequences and forecasts."""

__version__ = "0.1.0"
