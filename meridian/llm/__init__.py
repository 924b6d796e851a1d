"""Operators for large-scale training-data pipelines.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
