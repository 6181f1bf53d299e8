"""Fuel telemetry on Spark."""
