"""Ordered-signal analytics on PySpark: DataFrame operators for loss-aware ordered streams."""
