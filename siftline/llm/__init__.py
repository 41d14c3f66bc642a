"""Training-data operators: decontamination, deduplication, encoding, archives and models.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
