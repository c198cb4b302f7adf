"""Training-data operators: tokenising, filtering, de-duplication, search and packing.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
