"""Training-data operators for large document corpora.

Nothing outside this subpackage (and the top-level ``corpus_pipeline.py``)
imports it; the rest of the library works without it.
"""
