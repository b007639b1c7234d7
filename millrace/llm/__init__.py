"""Operators of a training-data pipeline. Nothing else in millrace imports this subpackage."""
