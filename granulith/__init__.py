"""Particle-table analytics on Spark: decisions, overlays, statistics, evaluation and calibration."""
