"""Training-data operators: ten stages that turn a raw corpus into packed token sequences.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
