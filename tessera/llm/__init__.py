"""Training-data operators: mixing, chat, HTML, top-k, token files, secrets, near-dedup, packing, quality, URLs, clustering,
BPE, phrases.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
