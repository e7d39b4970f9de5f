"""Telemetry and evidence analytics on PySpark DataFrames."""
