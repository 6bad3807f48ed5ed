"""Byte-level work on one document at a time, in plain Python: nothing here knows of Spark."""
