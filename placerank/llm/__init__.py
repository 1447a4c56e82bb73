"""Operators of a training-data pipeline; `queries.py` registers them, `corpus_pipeline.py` at the top chains five."""
