"""Corpus operators for training-data pipelines.

One module per operator; ``queries`` registers them. Nothing outside this
subpackage (and ``corpus_pipeline.py``) imports it.
"""
