"""Training-data operators: deduplication, tokens, packing, language, decontamination, chat, HTML, secrets.

Nothing outside this folder (and corpus_pipeline.py) imports it.
"""
