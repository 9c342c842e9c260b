"""Training-data operators: ten corpus-scale jobs and the registry of their queries.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
