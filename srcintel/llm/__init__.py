"""Operators for training-data pipelines: scoring, dedup, packing, mixing, filtering, encoding.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
